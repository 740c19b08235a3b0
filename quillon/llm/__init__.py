"""Operators for building training corpora: near-duplicate search, language identification, sharded tables,
audio features, license scans, quality classification, decontamination, substring deduplication, secret
scans and BPE encoding.  Nothing outside this subpackage imports it."""
