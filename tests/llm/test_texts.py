"""Operators that return a row for each document, against brute force."""

import math
import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from changeflow.llm import (bpe_replay, common, cross_parse, decontaminate, langid, license_scan, substring_dedup, token_attribution,
                            token_store)
from changeflow.llm.common import ChunkEncoder, new_path, ranges
from changeflow.llm.elias_fano import EliasFano
from changeflow.llm.license_rules import BASE, rules

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(df, columns, expected):
    assert rows_of(df, *columns) == sorted(expected, key=repr)


# --- op1

def scan_brute(text):
    words = brute.alnum(text)
    line, found = f" {' '.join(words)} ", []
    for r in rules():
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
            start = line[:m.start()].count(" ") - 1
            found.append((start, -(start + m[0].count(" ") + 1), r.priority, r.order, r.label, r.confidence, r.base))
            assert r.keyword in m[0].split()
    found.sort()
    kept = [d for i, d in enumerate(found) if not any(-e[1] >= -d[1] and e[2] <= d[2] for e in found[:i])]
    base = [d for d in found if d[6]]
    labels = {d[4] for d in base}
    return (len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
            ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in kept})), max((d[5] for d in kept), default=0.0))


@pytest.mark.parametrize("which", ["docs", "sample"])
def test_license_scan(which, docs, rows, sample):
    df, texts = (docs, rows) if which == "docs" else sample
    same(license_scan.scan(df), ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"),
         [(d, *scan_brute(t)) for d, t in texts])


def test_license_rules_are_many_and_base_stays(docs):
    assert len(rules()) > 300 and [r.label for r in rules()[:len(BASE)]] == [b[1] for b in BASE]
    row = license_scan.scan(docs).filter("doc_id = 20").first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (5, 0, 8, "cc-by,gpl,mit")
    assert "PythonUDF" not in license_scan.scan(docs)._jdf.queryExecution().toString()


def test_license_scan_empty(no_docs):
    assert license_scan.scan(no_docs).collect() == []


# --- op2

@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1 << 40], list(range(0, 9000, 3)), [-4, -4, 0, 7]])
def test_elias_fano(values):
    ef, end = EliasFano.from_bytes(b"x" + EliasFano.build(values).to_bytes(), 1)
    assert end == len(EliasFano.build(values).to_bytes()) + 1
    assert [ef.select(i) for i in range(len(values))] == values
    assert ef.slice(len(values) // 2, len(values) - len(values) // 2).tolist() == values[len(values) // 2:]
    with pytest.raises(IndexError):
        ef.select(len(values))


@pytest.mark.parametrize("values", [[-(1 << 63), (1 << 63) - 1], [-(1 << 63)] * 3 + list(range(700)) + [(1 << 63) - 1] * 2, [-(1 << 62), 1 << 62], [(1 << 63) - 1]])
def test_elias_fano_of_any_span(values):
    ef, _ = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
    assert ef.slice(0, ef.n).tolist() == values and [ef.select(i) for i in range(ef.n)] == values
    assert not len(values) > 1 or ef.slice(1, 1).tolist() == values[1:2]
    with pytest.raises(ValueError):
        EliasFano.build([(1 << 63) - 1, -(1 << 63)])


def test_elias_fano_is_near_the_bound():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 10_000))
    assert len(EliasFano.build(values).to_bytes()) * 8 / len(values) < 2.5 + np.log2((1 << 40) / len(values))


@pytest.mark.parametrize("which", ["docs", "sample", "no_docs"])
def test_token_store(which, spark, docs, no_docs, rows, sample):
    df, texts = {"docs": (docs, rows), "sample": sample, "no_docs": (no_docs, [])}[which]
    folder = new_path(spark, "store")
    token_store.write_store(df, folder, LIBRARY, docs_per_file=20)
    got = token_store.digest(token_store.read_store(spark, folder)).collect()
    tok = Tokenizer.from_file(LIBRARY)
    tok.encode_special_tokens = True
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in texts]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((d, len(x), crc(x)) for d, x in ids), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_token_store_with_the_librarys_defaults(spark, rows, tmp_path):
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"x{end}{end}y", f"a  {end}  b", f"one\n{end}\ntwo {end}", f"{end} {end}\n\n {end}", "<|endoftext| >", f"it's{end}'s"]
    texts += [(t or "").replace(" ", f" {end} ", 3).replace("e", f"e{end}", 2) for _, t in rows] + [f"a [long  one] b <s> c\t<é> d<é>é <s>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = Tokenizer.from_file(LIBRARY)
    more.add_tokens([AddedToken("[long  one]"), AddedToken("<s>", lstrip=True, rstrip=True), AddedToken("<é>", special=True)])
    more.save(str(tmp_path / "more.json"))
    for path in (LIBRARY, str(tmp_path / "more.json")):
        tok = Tokenizer.from_file(path)
        ids = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert 50256 in ids[0] and len(ids[1]) == 2
        folder = new_path(spark, "store")
        token_store.write_store(df, folder, path)
        got = token_store.digest(token_store.read_store(spark, folder))
        starts = np.cumsum([0, *map(len, ids)]).tolist()
        same(got, ("doc_id", "start", "n_tokens", "ids_crc32"),
             [(i, starts[i], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)])


def test_lost_attempts_leave_no_trace(spark, sample):
    folder = new_path(spark, "store")
    token_store.write_store(sample[0], folder, LIBRARY)
    before = rows_of(token_store.digest(token_store.read_store(spark, folder)), "doc_id", "start", "n_tokens", "ids_crc32")
    from changeflow.llm.common import filesystem
    fs, path = filesystem(folder)
    with fs.open_output_stream(f"{path}/files/orphan.ids") as f:      # as a killed task would leave it
        f.write(b"half a file")
    assert rows_of(token_store.digest(token_store.read_store(spark, folder)), "doc_id", "start", "n_tokens", "ids_crc32") == before


# --- op4

@pytest.mark.parametrize("group_chars", [1 << 20, 60])
def test_decontamination(docs, rows, spark, items, group_chars):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(docs, bench, group_chars=group_chars)
    same(got, ("doc_id", "n_words", "n_hit", "items"), brute.contamination(rows, items))
    clean = rows_of(decontaminate.remove_contaminated(docs, bench), "doc_id")
    assert clean == sorted(((d,) for (d, *_), (_, _, hit, _) in zip(rows, brute.contamination(rows, items)) if not hit), key=repr)


@pytest.mark.parametrize("group_chars", [1 << 20, 60])
def test_decontamination_without_the_written_windows(docs, spark, items, monkeypatch, group_chars):
    bench = spark.createDataFrame(items, "item_id long, text string")
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet",
                        lambda self, path, *a, **k: None if "benchmark-windows" in path else write(self, path, *a, **k))
    with pytest.raises(Exception, match="is not found"):
        decontaminate.annotate(docs, bench, group_chars=group_chars).collect()


def test_decontamination_of_groups_over_several_slices(docs, spark, items, monkeypatch):
    """Many groups, each passed over several slices: as with one group, spans
    and columns included, and no automaton is built twice for one pass."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.annotate(docs, bench)
    monkeypatch.setattr(decontaminate, "text_slices", lambda batches: (b.slice(i, 3) for b in batches for i in range(0, b.num_rows, 3)))
    many = decontaminate.annotate(docs, bench, group_chars=60)
    assert many.columns == one.columns and rows_of(many, *many.columns) == rows_of(one, *one.columns)
    assert many.filter("n_hit > 0").count() > 0 and len({r.n_items for r in decontaminate.digest(many).collect()}) > 1


def test_token_store_of_wide_ids(spark):
    """Ids of a 64-bit hash, over the whole range."""
    ids = [-(1 << 63), -(1 << 62) - 5, -1, 0, 7, 1 << 61, (1 << 63) - 2, (1 << 63) - 1, None]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(2)
    folder = new_path(spark, "wide")
    token_store.write_store(df.coalesce(1), folder, LIBRARY)
    assert sorted((r.doc_id for r in token_store.read_store(spark, folder).collect()), key=repr) == sorted(ids, key=repr)


def test_decontamination_with_a_part_of_a_group(spark):
    folder = new_path(spark, "part")
    spark.createDataFrame([(1, " a b ")], "item_id long, window string").write.parquet(folder)
    assert decontaminate._matcher(folder, 1).n_words == [2]
    decontaminate._MATCHERS.clear()
    with pytest.raises(RuntimeError, match="1 of 2"):
        decontaminate._matcher(folder, 2)


def test_decontamination_maps_to_the_original(spark):
    df = spark.createDataFrame([(1, "Xx Éé, One-TWO three; four")], "doc_id long, text string")
    got = decontaminate.annotate(df, spark.createDataFrame([(9, "one two")], "item_id long, text string")).first()
    (span,) = got.spans
    assert (got["text"][span.start:span.end], got.n_hit, got["items"]) == ("One-TWO", 2, [9])


def test_decontamination_without_items(docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.annotate(docs, none).filter("n_hit > 0").count() == 0
    assert decontaminate.annotate(no_docs, none).count() == 0


def test_decontamination_sample(sample, spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute.contamination(sample[1], [(r.item_id, r.text) for r in bench.collect()])
    assert any(e[2] for e in expected)
    same(decontaminate.annotate(sample[0], bench), ("doc_id", "n_words", "n_hit", "items"), expected)


# --- op5

@pytest.mark.parametrize("which", ["docs", "sample"])
def test_bpe_round_trip(which, docs, rows, sample):
    df, texts = (docs, rows) if which == "docs" else sample
    tok = brute.tokenizer()
    coded = [(d, t or "", tok.encode_ordinary(t or "")) for d, t in texts]
    same(bpe_replay.digest(df, RANKS, PATTERN), ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
         [(d, len(x), brute.sha(" ".join(map(str, x))), brute.sha(t)) for d, t, x in coded])


def test_bpe_encode_then_decode(docs, no_docs):
    coded = bpe_replay.encode(docs, RANKS, PATTERN)
    assert coded.columns == [*docs.columns, "ids"]
    back = bpe_replay.decode(coded, RANKS)
    assert back.filter(F.decode("decoded", "UTF-8") != F.coalesce("text", F.lit(""))).count() == 0
    assert bpe_replay.encode(no_docs, RANKS, PATTERN).count() == 0


def test_bpe_decode_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [31373])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe_replay.decode(df, RANKS).orderBy("doc_id").collect()] == [b"", b"", b"hello"]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe_replay.decode(spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>"), RANKS).collect()


def merge_one(tokens, word):
    """The rule for one word: merge the leftmost pair of lowest rank."""
    rank = {t: i for i, t in enumerate(tokens)}
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return [rank[p] for p in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_replay_where_a_merge_makes_a_pair_of_lower_rank():
    tokens = [bytes([b]) for b in range(256)] + [b"abcd", b"xab", b"bc", b"abc", b"ab", b"cd", b"aa", b"aaa"]
    words = [b"abcdabcd", b"abcabcd", b"xabc", b"xabxab", b"aaaaa", b"aaaaaaab", b"bcd", b"abcabc", b"z"]
    rng = np.random.default_rng(0)
    words += [bytes(rng.choice(list(b"abcdx"), rng.integers(1, 14)).tolist()) for _ in range(500)]
    words += [bytes(rng.choice(list(b"ab"), rng.integers(1, 40)).tolist()) for _ in range(300)]
    assert replayed(tokens, words) == [merge_one(tokens, w) for w in words]


def replayed(tokens, words):
    ids, n = bpe_replay.MergeReplay(tokens)(words)
    ends = np.cumsum(n)
    return [ids[b - k:b].tolist() for b, k in zip(ends, n)]


def test_replay_of_random_vocabularies():
    """Any set of tokens in any order of ranks, with repeated letters."""
    rng = random.Random(8)
    for _ in range(60):
        letters = "abc"[:rng.choice([1, 2, 3])]
        made = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 6))).encode() for _ in range(rng.randint(1, 40))}
        tokens = [bytes([b]) for b in range(256)] + rng.sample(sorted(made), len(made))
        words = ["".join(rng.choice(letters + "z") for _ in range(rng.randint(1, 30))).encode() for _ in range(80)]
        words += ["".join(rng.choice(letters) for _ in range(50)).encode() for _ in range(20)]
        assert replayed(tokens, words) == [merge_one(tokens, w) for w in words]


def test_replay_of_long_words():
    tok = brute.tokenizer()
    rng = random.Random(9)
    words = [b"x" * 5000, b"ab" * 3000, bytes(rng.randrange(97, 123) for _ in range(20_000)), bytes(rng.randrange(256) for _ in range(20_000)), b"the" * 4000]
    assert replayed(bpe_replay.read_ranks(RANKS), words) == [tok._encode_single_piece(w) for w in words]


@pytest.mark.parametrize("most", [5, 300_000])
def test_chunk_memo(rows, most):
    tok = brute.tokenizer()
    texts = [t for _, t in rows]
    encoder = ChunkEncoder(bpe_replay.ReplayEncoder(bpe_replay.read_ranks(RANKS), PATTERN), max_chunks=most)
    for _ in range(2):
        ids, n = encoder(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for t in texts for i in tok.encode_ordinary(t or "")]
        assert n.tolist() == [len(tok.encode_ordinary(t or "")) for t in texts]


def test_ranges():
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


# --- op7

@pytest.mark.parametrize("which, size", [("docs", 35), ("docs", 3), ("docs", 8), ("sample", 35), ("sample", 10)])
def test_substring_dedup(which, size, docs, rows, sample):
    df, texts = (docs, rows) if which == "docs" else sample
    expected = brute.repeated_words(texts, size)
    assert any(e[2] for e in expected)
    same(substring_dedup.dedup(df, size), ("doc_id", "n_words", "n_removed", "kept"), expected)


def test_substring_dedup_bounds_what_a_worker_holds(spark, no_docs):
    """Rows reach Python in batches of a few MB, a lower setting stays, and
    another operator's table goes."""
    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)], pa.int64())], ["most"])
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1600).alias("text"))
    try:
        spark.conf.set(key, "64m")
        substring_dedup.dedup(no_docs)
        assert texts.mapInArrow(sizes, "most long").first().most <= 2 * common.BATCH_BYTES
        spark.conf.set(key, "1m")
        substring_dedup.dedup(no_docs)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
    common.kept_in_worker("table", list)
    common.forget_kept()
    assert not common._KEPT


def test_substring_dedup_keeps_other_texts(docs, rows, no_docs):
    got = {r.doc_id: r for r in substring_dedup.remove_repeated(docs).collect()}
    assert substring_dedup.remove_repeated(docs).columns == docs.columns
    assert got[8].text == dict(rows)[8] and got[1].text is None
    assert got[15].n_chars == len(got[15].text) < len(dict(rows)[15])
    assert substring_dedup.dedup(no_docs).count() == 0


# --- op8

def test_language_id_on_held_out_documents(sample):
    got = langid.digest(sample[0]).join(sample[0].select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_id_defined_cases(docs, no_docs, sample):
    model = langid.fit(sample[0])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[1] == got[2] == got[3] == got[10] == ("und", 0.0)
    assert got[4][0] in model
    assert langid.predict(docs, {}).filter("lang_pred != 'und'").count() == 0
    assert langid.fit(no_docs) == {} and langid.predict(no_docs, model).count() == 0
    kept = {r.text for r in langid.keep_identified(sample[0].unionByName(docs.select(*sample[0].columns))).collect()}
    assert not {"12345 !!! ...", "", None} & kept and {"word", "Two words"} <= kept


def test_language_stage_rejects_by_bits(sample, spark):
    df = sample[0].select("doc_id", "text", "lang")
    rng = np.random.default_rng(6)
    gibberish = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 11))) for _ in range(k)) for k in (8, 30, 200)]
    strange = ["Быстрая коричневая лиса прыгает через ленивую собаку", "これは習ったことのない言語で書かれた文章です、まったく"]
    short = ["Qzx", "Жук."]
    added = spark.createDataFrame([(9_000_000 + i, t, None) for i, t in enumerate([*gibberish, *strange, *short])], df.schema)
    kept = langid.keep_identified(df.unionByName(added))
    clean = [(d, t) for d, t in sample[1] if any(c.isalpha() for c in t or "")]
    assert rows_of(kept, "doc_id", "text") == sorted([*clean, *((9_000_005 + i, t) for i, t in enumerate(short))], key=repr)


def test_language_stage_without_anything_learned(sample, docs):
    for df, texts in ((sample[0], sample[1]), (docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])):
        kept = langid.keep_identified(df.withColumn("lang", F.lit(None).cast("string")))
        assert rows_of(kept, "doc_id", "text") == sorted(((d, t) for d, t in texts if any(c.isalpha() for c in t or "")), key=repr)


def longest_matches(train, text):
    """Phrases of the greedy cross-parse of bytes, by searching ``train``."""
    n, i = 0, 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i:i + k + 1] in train:
            k += 1
        i, n = i + max(1, k), n + 1
    return n


def test_cross_parse_of_lanes():
    rng = random.Random(1)
    for _ in range(150):
        some = "abc d"[:rng.choice([2, 3, 5])]
        train = "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 5, 60, 300]))).encode()
        texts = ["".join(rng.choice(some + "zé") for _ in range(rng.choice([0, 1, 3, 10, 77, 200]))).encode() for _ in range(6)]
        texts += ["".join(rng.choice(some) for _ in range(150)).encode(), train * 3]
        automaton = cross_parse.Automaton(train)
        for lane in (1, 2, 7, 64, 1024):
            assert automaton.phrases(cross_parse.Lanes(texts, lane)).tolist() == [longest_matches(train, t) for t in texts]


def test_language_id_against_brute_force(sample, docs, rows):
    """lang_pred and score of every document, a phrase at a time."""
    model = langid.fit(sample[0])
    langs = sorted(model)
    by_words = re.compile(r"[^\W\d_]+")

    def expected(text):
        words = by_words.findall(text.lower()) if text else []
        data = f" {' '.join(words)} ".encode() if words else b""
        if not data:
            return "und", 0.0
        cost = sorted((longest_matches(model[x], data) * math.log2(len(model[x])) / len(data), x) for x in langs)
        return cost[0][1], max(0.0, 1 - cost[0][0] / cost[1][0])
    # the long text of random words is left to the other tests
    for frame, plain in ((sample[0], sample[1][:120]), (docs, [r for r in rows if len(r[1] or "") < 20_000])):
        got = {(r.doc_id, r.text): (r.lang_pred, round(r.score, 9)) for r in langid.predict(frame.select("doc_id", "text"), model).collect()}
        for doc_id, text in plain:
            lang, score = expected(text)
            assert got[doc_id, text] == (lang, round(score, 9))


def test_training_texts_are_whole_and_bounded(spark):
    words = lambda k, n: " ".join(f"w{chr(97 + (k * 7 + i) % 26)}{chr(97 + i % 26)}" for i in range(n))     # noqa: E731
    rows = [(3 * i, words(i, 50), "aa") for i in range(200)] + [(10_000 + 3 * i, words(i, 20_000), "aa") for i in range(5)]
    rows += [(20_000 + i, words(i, 30_000 + i), "long") for i in range(9)] + [(30_000 + i, "copy of one text", "copies") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    whole = {t for _, t, _ in rows}
    chosen = [tuple(r) for r in langid.training_rows(df, bytes_per_lang=4000).select("lang", "text").collect()]
    assert {t for _, t in chosen} <= whole and {x for x, _ in chosen} == {"aa", "long", "copies"}
    size = {x: sum(len(t) for y, t in chosen if y == x) for x in ("aa", "long", "copies")}
    assert 3000 < size["aa"] <= 4000 and size["copies"] <= 4000
    held = [t for i, t, x in rows if x == "long" and zlib.crc32(str(i).encode()) % 3 != 1]
    assert [t for x, t in chosen if x == "long"] == [min(held, key=len)]


def test_many_languages(spark, monkeypatch):
    """Hundreds of languages share the bound on all automata."""
    rng = random.Random(4)
    rows = []
    for k in range(120):
        own = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(12)]
        rows += [(k * 100 + i, " ".join(rng.choice(own) for _ in range(60)), f"l{k:03}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(langid, "TOTAL_BYTES", 120 * 1000)
    model = langid.fit(df)
    assert len(model) == 120 and sum(map(len, model.values())) <= 1.1 * langid.TOTAL_BYTES
    held = [r for r in langid.predict(df, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held) > 0
    monkeypatch.setattr(langid, "MAX_LANGS", 100)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(df)


def test_training_ignores_held_out_rows(sample):
    df, _ = sample
    spoiled = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert langid.fit(spoiled) == langid.fit(df)


# --- op9

@pytest.mark.parametrize("rule", token_attribution.RULES)
def test_token_attribution(docs, rows, rule):
    got = token_attribution.attribute(docs, RANKS, PATTERN, rule=rule).collect()
    tok = brute.tokenizer()
    expected = []
    for doc_id, text in rows:
        if not text:
            continue
        data = text.encode()
        parts = re.findall(rb"[^\n]*\n|[^\n]+", data)
        bounds = np.cumsum([0, *map(len, parts)])
        tokens, at = np.zeros(len(parts)), 0
        for token in tok.decode_tokens_bytes(tok.encode_ordinary(text)):
            shares = [max(0, min(at + len(token), b) - max(at, a)) / len(token) for a, b in zip(bounds, bounds[1:])]
            inside = [i for i, s in enumerate(shares) if s]
            if rule == "split":
                tokens += shares
            else:
                tokens[inside[0 if rule == "first" else -1]] += 1
            at += len(token)
        chars = np.cumsum([0, *(len(p.decode()) for p in parts)])
        expected += [(doc_id, i, int(chars[i]), int(chars[i + 1]), round(float(x), 6)) for i, x in enumerate(tokens)]
    assert sorted(((r.doc_id, r.section, r.char_start, r.char_end, round(r.n_tokens, 6)) for r in got), key=repr) == sorted(expected, key=repr)


def test_token_attribution_fields(spark, no_docs):
    df = spark.createDataFrame([(1, "A title", "one\ntwo"), (2, None, "body"), (3, "", None)], "doc_id long, title string, body string")
    got = token_attribution.attribute(df, RANKS, PATTERN, fields=("title", "body")).collect()
    tok = brute.tokenizer()
    assert [(r.doc_id, r.field, r.section) for r in sorted(got)] == [(1, "body", 0), (1, "body", 1), (1, "title", 0), (2, "body", 0)]
    assert sum(r.n_tokens for r in got if r.doc_id == 1) == len(tok.encode_ordinary("A title\none\ntwo"))
    assert token_attribution.attribute(no_docs, RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_attribution.attribute(df, RANKS, PATTERN, fields=("title",), rule="most")
