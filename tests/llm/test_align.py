"""Cross-tokenizer alignment against a plain version that takes each text whole."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from scryline.llm import align
from tests.conftest import SMALL

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "x\u2581y ok", "x \u2581 y ok", "\n \n x", "tab\t x", "\u00e9\u3000 \u00e8", "<|endoftext|> <s> </s> <0x41> <unk>", "\u4e2d\u6587\u5b57 \u6d4b\u8bd5", "\U0001f389\U0001f389 \U0001f389",
    "a\x00b c", "====== ======", "'s 't can't", "a\u2003b", "\ufb01 ligature \u00bd \u212b", "a" * 3000, "x\r\n\r\n  y", "\ufeff bom", "a\u200b b", "ab" * 300 + " end", "word " * 3_000,
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    tokens = align.Tokenizers(*PATHS)
    found, counts = [], Counter()
    for i, t in rows:
        whole = (" " + (t or "")).encode()
        a, b = tokens.a.encode(" " + (t or ""), add_special_tokens=False).ids, tokens.b.encode(t or "")
        if not t or b"".join(tokens.bytes_a[x] for x in a) != whole or b"".join(tokens.bytes_b[x] for x in b) != whole:
            found.append((i, [], [], [], Counter()))
            continue
        ends = [np.cumsum([len(table[x]) for x in ids]).tolist() for table, ids in ((tokens.bytes_a, a), (tokens.bytes_b, b))]
        cuts, groups, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for c in cuts:
            upto = [bisect.bisect_right(e, c) for e in ends]
            groups.append((a[at[0] : upto[0]], b[at[1] : upto[1]]))
            at = upto
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(links.keys())
        found.append((i, a, b, groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    digest = lambda groups: hashlib.sha256(";".join("|".join(",".join(map(str, g)) for g in pair) for pair in groups).encode()).hexdigest() if groups else ""
    return [(i, len(a), len(b), len(g), sum(k.values()), sum(n for p, n in k.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in k.items()), digest(g)) for i, a, b, g, k in found]


@pytest.fixture(scope="module")
def rows(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    return [*real, *real[:3], (None, "no id here"), *[(10_000 + i, t) for i, t in enumerate(ODD)]]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("most", [align.FREQUENT, 50, 0])
def test_equals_plain_version(spark, rows, most):
    """Whether pairs are broadcast or joined makes no difference."""
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, rid string, key int").repartition(3)
    assert order(align.alignment(docs, *PATHS, most).select(*COLUMNS).collect()) == order(plain(rows))


def test_small_blocks(rows, monkeypatch):
    """Blocks of any size, and parts in runs of any length, give the same."""
    want = {(r[0], r[7]) for r in plain(rows)}
    monkeypatch.setattr(align, "RUN", 3)
    aligner, got = align.Aligner(*PATHS), set()
    for lo in range(0, len(rows), 7):
        out = aligner(pa.array([i for i, _ in rows[lo : lo + 7]], pa.int64()), pa.array([t for _, t in rows[lo : lo + 7]], pa.string()))
        got |= set(zip(out.column("doc_id").to_pylist(), out.column("groups_sha256").to_pylist(), strict=True))
    assert got == want


def test_empty_table(spark):
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
