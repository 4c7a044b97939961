"""Source divergence: term sets stand for all documents, and repeats are counted before vectors are made."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import divergence


def combined(rows):
    text, source, lang = zip(*rows, strict=True)
    return [r for b in divergence._combined([pa.RecordBatch.from_arrays([pa.array(text), pa.array(source), pa.array(lang, pa.int32())], ["text", "source", "lang_no"])])
            for r in b.to_pylist()]


@pytest.mark.parametrize("joined", [1 << 24, 200, 1])
def test_term_sets_stand_for_all_documents(monkeypatch, joined):
    monkeypatch.setattr(divergence, "JOINED", joined)
    monkeypatch.setattr(divergence, "SET", 3)
    rng = np.random.default_rng(9)
    rows = [(" ".join(rng.choice(["a", "B", "b", "ß", "c", "dd", *[f"r{chr(97 + k % 26)}{chr(97 + k // 26)}"] * 2], 12)) if k % 9 else None, f"s{k % 4}", k % 3) for k in range(200)]
    counts, docs = collections.Counter(), collections.Counter()
    for text, source, lang in rows:
        words = (text or "").replace("B", "b").split()
        counts.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    sets = combined(rows)
    assert all(len(r["terms"]) == len(set(r["terms"])) <= 3 for r in sets)
    found, fit = collections.Counter(), collections.Counter()
    for r in sets:
        if r["kind"] == divergence.VECTOR:
            found.update({(r["lang_no"], r["source"], t): r["weight"] for t in r["terms"]})
        elif r["kind"] == divergence.FIT:
            fit.update((r["lang_no"], t) for t in r["terms"])
    assert found == counts
    assert fit.keys() == docs.keys() and all((fit[x] >= divergence.MIN_DOCS) == (n >= divergence.MIN_DOCS) and fit[x] <= n for x, n in docs.items())


def test_repeats_are_counted_before_the_vectors():
    sets = combined([("some words again and again", "s", 0)] * 1000)
    assert sum(len(r["terms"]) for r in sets) <= 4 * (2 + divergence.MIN_DOCS)
