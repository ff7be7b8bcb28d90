"""Aligned tokens against a loop over all texts with the other library's tokenizer."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_contracts import ODD, odd_docs

from bidlake.llm import alignment


def brute_force(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    side_a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # Byte-level alphabet: printable bytes stand for themselves, the others from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}

    def bytes_a(i):
        return bytes(byte[c] for c in side_a.id_to_token(i))

    def bytes_b(i):
        piece = side_b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if side_b.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for text in texts:
        a, b = (side_a.encode(f" {text}", add_special_tokens=False).ids, side_b.encode(text)) if text else ([], [])
        spelled = [[f(i) for i in ids] for f, ids in ((bytes_a, a), (bytes_b, b))]
        if not text or {b"".join(s) for s in spelled} != {f" {text}".encode()}:
            found.append(None)
            continue
        ends = []
        for s in spelled:
            at, e = 0, []
            for t in s:
                at += len(t)
                e.append(at)
            ends.append(e)
        by_end = dict(zip(ends[1], b, strict=True))
        links = [(i, by_end[e]) for i, e in zip(a, ends[0], strict=True) if e in by_end]
        cut = set(ends[0]) & set(ends[1])
        groups = []
        for ids, e in ((a, ends[0]), (b, ends[1])):
            side = [[]]
            for i, at in zip(ids, e, strict=True):
                side[-1].append(str(i))
                if at in cut:
                    side.append([])
            groups.append([",".join(g) for g in side[:-1]])
        said = ";".join(f"{x}|{y}" for x, y in zip(*groups, strict=True))
        found.append((len(a), len(b), len(cut), links, said))
        counts.update(links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = [(0,) * 6 + ("",) if f is None else (*f[:3], len(f[3]), sum(counts[x] == top[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest()) for f in found]
    return out, counts, top


TEXTS = ["a▁b", "<s> hi </s> <|endoftext|>", "  lead", "tail  \n\n\t", "\x00x", " ", "▁", "ﬁ \xbd ①", "<0x41>", " " * 3000, "\r\n a", "\U0001f600\U0001f600 x", "de la maison, de la rue " * 40, "de la maison, de la rue " * 40]


@pytest.mark.parametrize("limits", [{}, {"RUN_LINKS": 400, "FAN": 3, "TASK_BYTES": 8000, "RADIXES": 4}])
def test_alignment(spark, sf_dir, monkeypatch, limits):
    """Whole texts of the smallest table and awkward ones, in few runs and in many that are
    merged in rounds and dealt to several tasks."""
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    texts = [*(r["text"] for r in given.collect()), *TEXTS, *ODD]
    want, counts, top = brute_force(texts)
    got = alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], texts[r["doc_id"]]
    assert sum(r["n_links"] for r in got) == sum(counts.values())


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "RUN_LINKS", 50)
    texts = ["the cat sat on the mat"] * 40 + ["a dog, the dog"] * 7
    _, counts, top = brute_force(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    table = alignment.written(alignment.runs(docs, alignment.default_files(), alignment.piece_model()), "test-runs")
    got = {(r["a"], r["b"]): (r["links"], r["best"]) for r in alignment.counts(alignment.pair_counts(table)).collect()}
    assert got == {p: (n, n == top[p[1]]) for p, n in counts.items()}


def test_odd_rows(spark):
    d = odd_docs(spark).withColumns({"run": F.col("text"), "radix": F.col("doc_id")})
    assert alignment.align(d).count() == d.count()
    assert alignment.align(d.limit(0)).count() == 0
