"""The sample of the language model, taken of each language."""

import numpy as np

from tidelog.llm import language

WORDS = {"en": "the house and a garden with many trees", "de": "das Haus und ein Garten mit vielen Baeumen", "fr": "la maison et un jardin avec beaucoup arbres", "es": "la casa y un huerto con muchos manzanos"}


def rows_of(counts):
    return [(i, WORDS[c], c, None) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]


def test_a_rare_language_is_learned_and_found(spark):
    docs = spark.createDataFrame(rows_of({"en": 300, "de": 200, "fr": 1, "es": 1}), "doc_id long, text string, lang string, source string")
    model = language.learn(docs, sample=10)
    for row, lang in zip(model, language.LANGUAGES, strict=False):
        assert np.ptp(row) > 1, lang
    got = {(r.doc_id, r.language) for r in language.identify(docs, model).where("kept").collect()}
    assert got == {(r.doc_id, r.lang) for r in docs.collect()}


def test_the_sample_has_the_first_keys_of_each_language(spark):
    docs = spark.createDataFrame(rows_of({"en": 40, "de": 7}), "doc_id long, text string, lang string, source string")
    assert np.array_equal(language.learn(docs, sample=40), language.learn(docs, sample=4000))
    two = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' x y z') AS text", "lang", "source").where("lang = 'de'"))
    assert np.array_equal(language.learn(two, sample=7), language.learn(docs, sample=7))


def test_a_hot_key_takes_one_seat(spark):
    from tidelog.llm.common import first_by_hash

    df = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 7 ELSE id END AS k", "1 AS v")
    got = [r.k for r in first_by_hash(df, "k", 50).collect()]
    assert len(set(got)) == 50
    every = sorted(set(r.k for r in df.collect()))
    hashes = {r.k: r.h for r in df.distinct().selectExpr("k", "shiftrightunsigned(xxhash64(k), 1) AS h").collect()}
    assert sorted(got) == sorted(sorted(every, key=hashes.get)[:50])


PAGE = '<HTML data-x="{}" lang="fr"><body class="en the house">{}</body></html>'


def test_markup_declares_and_is_no_text():
    long = "y" * 100_000
    assert language.markup(PAGE.format(long, "der Baum")) == ("fr", "  der Baum  ")
    assert language.markup("a <b lang=de> c") == (None, "a <b lang=de> c")
    assert language.markup("<html" * 50_000)[0] is None


def brute(rows, model):
    """The same fusion, row by row in plain Python, from the same word and run frequencies."""
    names, seen = [*language.LANGUAGES, language.NONE], []
    for text, lang, address in rows:
        said, text = language.markup(text) if text and "<" in text else (None, text)
        said = said or (lang[:2].lower() if lang is not None else None)
        host = address.split("://")[-1].split("/")[0].lower() if address else None
        ll = None
        if text and any(c.isalpha() for c in text):
            at = language.buckets(text)
            ll = [float(np.mean([row[b] for b in at])) * language.TEMPER * min(len(at), language.MOST) for row in model] if len(at) else [0.0] * len(names)
        best = language.NONE if ll is None or not any(ll) else names[int(np.argmax(ll))]
        seen.append((ll, (said if said in language.LANGUAGES else "other") if said is not None else None, host, best))
    out = []
    total = sum(best != language.NONE for *_, best in seen) or 1
    known = [r for r in seen if r[3] != language.NONE]
    flat = [(sum(r[3] == c for r in known) + 1) / (total + 4) for c in language.LANGUAGES]
    for ll, said, host, _ in seen:
        if ll is None:
            out.append((language.NONE, 1.0))
            continue
        prior = [p * (1 - language.NONE_SHARE) for p in flat]
        if host:
            own = [r for r in known if r[2] == host]
            tail = host.rpartition(".")[2] if "." in host else None
            wide = [r for r in known if tail and r[2] and "." in r[2] and r[2].rpartition(".")[2] == tail]
            up = [(sum(r[3] == c for r in wide) + language.SUFFIX_PULL * f) / (len(wide) + language.SUFFIX_PULL) for c, f in zip(language.LANGUAGES, flat, strict=True)]
            prior = [(sum(r[3] == c for r in own) + language.HOST_PULL * u) / (len(own) + language.HOST_PULL) * (1 - language.NONE_SHARE) for c, u in zip(language.LANGUAGES, up, strict=True)]
        score = []
        for i, c in enumerate(language.LANGUAGES):
            told = [r for r in known if r[3] == c and r[1]]
            score.append(ll[i] + np.log(prior[i]) + (np.log((sum(r[1] == said for r in told) + 2) / (len(told) + 10)) if said else 0))
        score.append(ll[4] + np.log(language.NONE_SHARE) + (np.log(1 / 5) if said else 0))
        share = np.exp(np.array(score) - max(score))
        out.append((names[int(np.argmax(score))], 1 / share.sum()))
    return out


def test_fusion_equals_brute_force(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    words = list(WORDS.values())
    rows = [(r.text, r.lang, r.source) for r in source[:120]]
    rows += [(PAGE.format("", words[i % 4] + " house"), None, f"http://h{i % 3}.{'de' if i % 2 else 'com'}/x") for i in range(40)]
    rows += [(None, "en", "a"), ("12 !!", None, "b"), ("zzz", "xx", ""), ("the", None, None), ("maison", "DE-at", "https://only.fr/")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    model = language.learn(docs)
    want = brute(rows, model)
    for r in language.identify(docs, model).collect():
        assert r.language == want[r.doc_id][0] and abs(r.confidence - want[r.doc_id][1]) < 1e-9, r
        assert r.kept == (r.language != language.NONE and r.confidence >= language.KEEP_FROM)


def test_pages_by_text_address_and_markup(spark):
    """Trained on documents; judged with and without what a page or a column declares."""
    from tidelog.llm import queries

    path = "/root/testdata/sf0.01"
    docs, pages = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "pages"))
    rows = queries.QUERIES["language_pages"](spark, path).collect()
    assert len(rows) == pages.count()
    said = {r.page_id: language.markup(r.html or "")[0] for r in pages.collect()}
    known = [r for r in rows if said[r.page_id] in language.LANGUAGES]
    assert not known or np.mean([r.language == said[r.page_id] for r in known]) > 0.9
    lang = {r.doc_id: r.lang for r in docs.collect()}
    alone = language.identify(docs, language.learn(docs), declared=None, address=None).collect()
    assert np.mean([r.language == lang[r.doc_id] for r in alone]) > 0.97
