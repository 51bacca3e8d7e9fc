import json
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import queries as q
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.ngram_join import ngram_components
from plumbline.llm.packing import Search, best_fit, least_bins, next_fit, pack, searched
from plumbline.llm.token_counts import count_tokens
from plumbline.llm.tokens import ByteIds, WordCounts, drops_white_space
from tests.conftest import MEDIUM, SMALL
from tests.llm import brute

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
FAST = ByteIds(Tokenizer.from_file(BYTE), Path(BYTE).read_text())
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "WORD"), (6, BASE), (7, BASE.upper()), (8, BASE + " eighteen"),
    (9, BASE.replace(" ", "\x0b\x0c ")), (10, BASE + "\n" + BASE), (11, "İstanbul KK éé line that repeats"),
    (12, "a line that repeats\nother <|endoftext|> text\nA LINE that repeats "), (13, "  a line that repeats\n\n\n"), (14, "x  y \n z  <|endoftext|>  <|ENDOFTEXT|> 　w v\n"),
    (15, "long " * 9000), (16, "long " * 9000 + "tail"), (17, "short line\nshort line"), (18, "short line"), (19, "\U0001f600" * 10 + "\n1"), (20, "\U0001f600" * 10),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, "x", 7) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string, row int")


def documents(spark, at):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]


def answer(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ngram_join_edges(edge):
    assert answer(ngram_components(edge), "doc_id", "n_shingles", "component_id") == brute.ngram(EDGE)


def test_ngram_join_whole_table(spark):
    assert answer(q.op3_ngram_jaccard_join(spark, MEDIUM), "doc_id", "n_shingles", "component_id") == brute.ngram(documents(spark, MEDIUM))


def test_ngram_join_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 40 + i % 15] + [f"own{i}"] * (i % 3))) for i in range(400)] + [(1000 + i, " ".join(f"z{i}x{j}" for j in range(30))) for i in range(20)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), star_rounds=2)
    assert answer(got, "doc_id", "n_shingles", "component_id") == brute.ngram(rows)


def test_ngram_join_null_and_repeated_ids(spark):
    near = " ".join(f"n{i}" for i in range(40))
    rows = [(None, near), (None, near + " x"), (7, near + " y"), (7, "other words are here " * 9), (9, near + " z"), (9, near + " z"), (None, None)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.component_id) == [(0, 36, 7), (0, 37, 7), (7, 4, 7), (7, 37, 7), (9, 37, 7), (9, 37, 7)] and len(got) == 7


def test_line_dedup(spark, edge):
    from pyspark.sql import functions as F

    out = dedup_lines(edge).withColumn("sha", F.sha2("kept_text", 256))
    assert out.columns[:3] == ["doc_id", "text", "row"]
    assert answer(out, "doc_id", "n_lines", "n_dropped", "sha") == brute.lines(EDGE)
    assert answer(q.op4_line_dedup(spark, MEDIUM), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.lines(documents(spark, MEDIUM))


def test_token_counts(spark, edge):
    made = Tokenizer.from_file(WORD)
    want = lambda rows: sorted((i, len((t or "").encode()), n := len(made.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    cols = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert answer(count_tokens(edge, WORD), *cols) == want(EDGE)
    assert answer(q.op2_token_counts(spark, SMALL), *cols) == want(documents(spark, SMALL))


def test_token_counts_of_tokenizers_that_keep_white_space(spark, edge):
    """What the file says decides, not the caller."""
    rows = [*EDGE, (900, "a b"), (901, "a  b"), (902, " a\tb\n"), (903, "a\u00a0b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = Tokenizer.from_file(BYTE)
    got = answer(count_tokens(df, BYTE), "doc_id", "n_tokens")
    assert got == sorted((i, len(made.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = answer(count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")), "doc_id", "n_tokens")
    assert got == sorted((i, len(pieces.encode(t or ""))) for i, t in rows)


def test_which_tokenizers_drop_white_space():
    word, byte = (json.loads(Path(x).read_text()) for x in (WORD, BYTE))
    assert drops_white_space(json.dumps(word)) and not drops_white_space(json.dumps(byte))
    for key, value in (("pre_tokenizer", None), ("pre_tokenizer", {"type": "Metaspace"}), ("pre_tokenizer", {"type": "BertPreTokenizer"}), ("normalizer", {"type": "Replace", "pattern": {"String": " "}, "content": "_"}), ("normalizer", {"type": "BertNormalizer"})):
        assert not drops_white_space(json.dumps(word | {key: value}))
    assert not drops_white_space(json.dumps(word | {"added_tokens": [word["added_tokens"][0] | {"content": "new york"}]}))
    assert drops_white_space(json.dumps(word | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))


def test_token_cache_knows_some(spark, tmp_path):
    at = f"file://{tmp_path}/cache"
    rows = documents(spark, SMALL)
    some = spark.createDataFrame(rows[:50], "doc_id long, text string")
    count_tokens(some, WORD, at).collect()
    before = spark.read.parquet(at).count()
    every = answer(count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), WORD, at), "doc_id", "n_tokens")
    made = Tokenizer.from_file(WORD)
    assert every == sorted((i, len(made.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    cache = spark.read.parquet(at)
    assert before <= 50 and cache.count() == cache.select("digest").distinct().count()


def test_token_cache_is_used_and_kept_apart(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    at = f"file://{tmp_path}/cache"
    first = answer(count_tokens(docs, WORD, at), "doc_id", "n_tokens")
    assert spark.read.parquet(at).count() == 2
    assert answer(count_tokens(docs, WORD, at), "doc_id", "n_tokens") == first == [(1, 2), (2, 2), (3, 0)]
    assert spark.read.parquet(at).count() == 2
    count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), at).collect()
    assert spark.read.parquet(at).count() == 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \t\n\u00a0\u3000\u0085ab'sZéΣ<|>1.\x1c\U0001f600", "<|endoftext|>", "  ", "'re "]), max_size=25).map("".join))
def test_words_are_the_whole(text):
    ids = FAST.tokenizer.encode(text, add_special_tokens=False).ids
    assert FAST.fast and FAST.of(text) == np.asarray(ids, "<u4").tobytes()
    made = Tokenizer.from_file(WORD)
    assert WordCounts(made).of([text.encode()]) == [len(made.encode(text, add_special_tokens=False).ids)]


def check_packing(rows, found, capacity=2048):
    made, by_doc, by_bin = Tokenizer.from_file(BYTE), defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert len(by_doc) == len(rows)
    for i, t in rows:
        ids = np.asarray([*made.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
            assert k == 0 or r.length == capacity
        assert at == len(ids) and len(by_doc[i]) == -(-at // capacity)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin), -(-sum(r.length for r in found) // capacity)


def test_packing(spark, edge):
    check_packing(EDGE, pack(edge, BYTE).collect())
    bins, bound = check_packing(documents(spark, SMALL), q.op7_best_fit_packing(spark, SMALL).collect())
    assert bins <= bound * 1.02 + 1


def squares(bins, sizes):
    return int((np.bincount(bins, weights=sizes) ** 2).sum())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80), st.sampled_from([next_fit, best_fit]))
def test_local_search_raises_squared_fills(lengths, start):
    sizes = np.array(lengths)
    before = start(sizes, 100)
    search = Search(sizes, before, 100)
    after = search.run(least_bins(sizes, 100))
    steps = search.moves + search.swaps + search.doubles
    assert np.bincount(after, weights=sizes).max() <= 100
    assert squares(after, sizes) >= squares(before, sizes) + 2 * steps
    assert least_bins(sizes, 100) <= len(set(after.tolist())) <= len(set(before.tolist()))
    bins, _ = searched(sizes, 100, True)
    assert bins.max() + 1 == len(set(bins.tolist())) <= len(set(best_fit(sizes, 100).tolist()))


def test_local_search_swaps():
    sizes, placed = np.array([70, 20, 60, 20, 30]), np.array([0, 0, 1, 1, 2])
    search = Search(sizes, placed, 100)
    assert len(set(search.run(2).tolist())) == least_bins(sizes, 100) == 2 and search.swaps + search.doubles > 0


def test_local_search_ends_where_nothing_fits():
    for sizes in (np.full(3000, 683), np.random.default_rng(1).integers(700, 1100, 3000)):
        bins, _ = searched(sizes, 2048, True)
        assert bins.max() + 1 == best_fit(sizes, 2048).max() + 1


def test_search_packs_documents(spark):
    sizes = np.array([r.length for r in q.op7_best_fit_packing(spark, MEDIUM).collect() if r.length < 2048])
    bins, steps = searched(sizes, 2048, False)
    assert bins.max() + 1 == best_fit(sizes, 2048).max() + 1 == least_bins(sizes, 2048)
    assert min(steps.values()) > 10 and next_fit(sizes, 2048).max() > 1.2 * bins.max()


def test_packing_in_levels(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    found = pack(docs, BYTE, group=150).collect()
    bins, bound = check_packing(documents(spark, MEDIUM), found)
    assert len({r.sequence_id >> 56 for r in found if r.sequence_id >= 0}) > 1 and bins <= bound + 2


def test_ids_of_latin_texts(spark):
    """Every Latin-1 character, alone, doubled and between others, and whole documents."""
    texts = [made for i in range(256) for c in [chr(i)] for made in (c, c + c, f"a{c}b", f" {c} ", f"1{c}2{c}", f"'{c}s", f"\n{c}\t")]
    texts += [chr(i) + chr(j) for i in range(256) for j in range(0, 256, 3)] + [t or "" for _, t in documents(spark, MEDIUM)]
    for text, ids in zip(texts, FAST.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert FAST.of(text) == np.asarray(ids.ids, "<u4").tobytes()


def test_lines_of_rows_without_ids(spark, monkeypatch):
    from plumbline.llm import line_dedup as x

    monkeypatch.setattr(x, "FLUSH", 3)
    rows = [(None, "line number one\nonly in the null ones\n x"), (None, "line number one\nand another line"), (None, "only in the null ones"), (5, "LINE number one \nand another line"), (5, "line number one")]
    df = spark.createDataFrame([(i, t, [1], "r") for i, t in rows], "doc_id long, text string, drops array<int>, row string").repartition(3)
    got = {(r.doc_id, r.text, r.kept_text, r.n_dropped, r.row) for r in dedup_lines(df).collect()}
    want = ["only in the null ones\n x", "", "only in the null ones", "LINE number one \nand another line", "line number one"]
    assert got == {(i, t, w, t.count("\n") - w.count("\n") + (w == "") if i is None and t != w else 0, "r") for (i, t), w in zip(rows, want)}


def test_line_shards_grow_with_the_input(spark, monkeypatch):
    """Small shards: of lines that occur once, few are suspected, however many there are; a line of all documents is sent
    once a flush; rows agree with brute force."""
    from plumbline.llm import line_dedup as x

    rng = np.random.default_rng(4)
    digests = rng.integers(0, 1 << 63, (300_000, 2), np.uint64)
    known = x.twice_seen(np.concatenate([digests, digests[:1000]]), np.zeros(301_000, bool))
    assert known[:1000].all() and known[300_000:].all() and known[1000:300_000].mean() < 0.05
    monkeypatch.setattr(x, "LINES", 400)
    monkeypatch.setattr(x, "FLUSH", 300)
    rows = [(i, "\n".join(["the line of them all", *(f"line of number {j}" for j in rng.integers(0, 4000, 5))])) for i in range(1500)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).selectExpr("*", "sha2(kept_text, 256) AS sha")
    assert answer(out, "doc_id", "n_lines", "n_dropped", "sha") == brute.lines(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for out in (ngram_components(none), dedup_lines(none), count_tokens(none, WORD), pack(none, BYTE)):
        assert out.count() == 0
