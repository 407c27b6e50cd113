"""Token counts and token files against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomline.llm import token_files
from loomline.llm.common import scratch
from loomline.llm.token_counts import count_prefixes, fitting_bytes, prefix_count, total_tokens

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(5)
    parts = ["the", "Öl", "don't", "'s", " ", "  ", "\n", "\t", "\n\n ", "12", "4,5", "ñandú", "▁", "▁▁x", " ", " ", "　", "<|endoftext|>", "</s>", "<s>", "<0x0A>", "😀", "...", "a.b", "x-'s", "\"'re", "é.", "e\u0301.", "3!'t", "…", "_x", "x" * 50, "\x1c", "\x85", "​", "é"]
    out = ["", " ", "  ", "\n", " a", "a ", "a  b", " \n ", None, "<|endoftext|>", "a <|endoftext|> b c", "the quick brown fox"]
    for _ in range(300):
        out.append("".join(r.choice(parts) + (" " if r.random() < 0.5 else "") for _ in range(r.randint(1, 30))))
    return out


def test_counts_and_prefixes(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    r = random.Random(8)
    unbroken = "".join(r.choice("aeiourstnlöß日本語\U0001f600-_'1") for _ in range(400))
    all_ = [*texts(), unbroken, "\x00\x01 \ue000x", "internationalisation"]
    docs = spark.createDataFrame(list(enumerate(all_)), "doc_id long, text string").withColumn("data", F.lit(1))
    ask = count_prefixes(docs, PIECE).withColumn("n", total_tokens()).withColumn("fit", fitting_bytes(9))
    rows = ask.withColumn("third", prefix_count(3)).withColumn("none", prefix_count(0)).withColumn("past", prefix_count(F.col("n_bytes").cast("int") + 1)).collect()
    assert len(rows) == len(all_)
    for x in rows:
        text = all_[x.doc_id] or ""
        raw = text.encode()
        want, end = [None] * len(raw), 0
        for k, c in enumerate(text):
            end += len(c.encode())
            want[end - 1] = len(model.encode(text[: k + 1]))
        assert x.prefix_tokens == want
        assert (x.n_bytes, x.n) == (len(raw), len(model.encode(text)))
        assert x.fit == max([i + 1 for i, c in enumerate(want) if c is not None and c <= 9], default=0)
        assert (x.none, x.past, x.third) == (0, None, want[2] if len(raw) > 2 else None)
    assert count_prefixes(docs.filter("doc_id < 0"), PIECE).count() == 0


def test_long_unbroken_text(spark):
    import sentencepiece

    text = "".join(random.Random(4).choice("abcdeéstrn") for _ in range(300_000))
    row = count_prefixes(spark.createDataFrame([(1, text)], "doc_id long, text string"), PIECE).select(total_tokens().alias("n"), prefix_count(100_001).alias("p"), "n_bytes").first()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert (row.n, row.n_bytes) == (len(model.encode(text)), len(text.encode()))
    head = text.encode()[:100_001]
    try:
        assert row.p == len(model.encode(head.decode()))
    except UnicodeDecodeError:
        assert row.p is None


@pytest.mark.parametrize("parts", [1, 5])
def test_files(spark, parts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BYTE)
    all_ = texts()
    rows = [(i * 2, t, 0) for i, t in enumerate(all_)] + [(None, "none first", 0), (4, "again", 0), (4, "again", 0)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(parts)
    got = sorted(((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in token_files.stored_tokens(docs, BYTE).collect()), key=lambda x: x[1])
    start, want = 0, []
    for d, t, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_pruning(spark):
    path = scratch(spark, "tokens")
    token_files.write_tokens(spark.range(1000).selectExpr("id as doc_id", "concat('text ', id) as text"), path, BYTE)
    one = token_files.read_tokens(spark, path).filter("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()
    from tokenizers import Tokenizer

    assert one.first().ids == [*Tokenizer.from_file(BYTE).encode("text 77").ids, 2]
    assert token_files.stored_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0


def test_memory_of_a_chunk():
    """Two workers share an executor's 1.2 GB beside its heap."""
    import tracemalloc

    from loomline.llm import pieces

    known, _ = pieces.byte_level_encoder(BYTE)
    data = np.frombuffer((b"some words of a text, " * (token_files.CHUNK // 22 + 1))[: token_files.CHUNK], np.uint8)
    tracemalloc.start()
    at, drop = pieces.byte_level_cuts(data, np.array([len(data)]))
    pieces.gather(pieces.encode_pieces(data, at, drop, known), known.bounds, known.ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20
