"""A changelog-table engine: an ordered log of key/value mutations, folded into a live view with DataFrame expressions."""
