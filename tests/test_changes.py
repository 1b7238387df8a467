"""C6 / C7 against a sequential fold, on random feeds (null keys, repeated
positions, insert-only columns), with the hot-key salting path forced."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeflow.operators import changes as ch

SCHEMA = "k long, v long, tag string"
FEED = "lsn long, seqval int, op_code int, k long, v long, tag string"

events_st = st.lists(st.tuples(st.sampled_from([0, 1, 2, 3, None]), st.sampled_from([1, 2, 3, 4]),
                               st.integers(0, 99)), min_size=0, max_size=40)
target_st = st.dictionaries(st.integers(0, 5), st.integers(100, 199), max_size=5)


def _feed(events):
    # two events share each lsn and differ in seqval
    return [(i // 2, i % 2, op, k, v, f"t{i}") for i, (k, op, v) in enumerate(events)]


def seq_strict(target, feed, insert_only=()):
    state = {k: {"v": v, "tag": "seed"} for k, v in target.items()}
    extra = []
    for lsn, seq, op, k, v, tag in sorted(feed, key=lambda r: (r[0], r[1])):
        row = {"v": v, "tag": tag}
        if k is None:
            if op == 2:
                extra.append((None, v, tag))
            continue
        if op == 1:
            state.pop(k, None)
        elif op == 2:
            if k not in state:
                state[k] = row
        elif op == 4:
            if k in state:
                new = dict(row)
                for c in insert_only:
                    new[c] = state[k][c]
                state[k] = new
    out = [(k, r["v"], r["tag"]) for k, r in state.items()] + extra
    return sorted(out, key=repr)


def seq_last_wins(target, feed):
    state = {k: (v, "seed") for k, v in target.items()}
    last = {}
    extra = []
    for lsn, seq, op, k, v, tag in sorted(feed, key=lambda r: (r[0], r[1])):
        if k is None:
            if op == 2:
                extra.append((None, v, tag))
            continue
        if op != 3:
            last[k] = (op, v, tag)
    for k, (op, v, tag) in last.items():
        if op == 1:
            state.pop(k, None)
        else:
            state[k] = (v, tag)
    return sorted([(k, v, t) for k, (v, t) in state.items()] + extra, key=repr)


def _rows(df):
    return sorted([tuple(r) for r in df.select("k", "v", "tag").collect()], key=repr)


def _frames(spark, target, events):
    t = spark.createDataFrame([(k, v, "seed") for k, v in target.items()], SCHEMA)
    f = spark.createDataFrame(_feed(events), FEED)
    return t, f


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(target=target_st, events=events_st)
def test_strict_matches_sequential(spark, target, events):
    t, f = _frames(spark, target, events)
    got = _rows(ch.apply_strict(t, f, ["k"], hot_rows=3))     # hot path forced
    assert got == seq_strict(target, _feed(events))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(target=target_st, events=events_st)
def test_strict_insert_only_column(spark, target, events):
    t, f = _frames(spark, target, events)
    got = _rows(ch.apply_strict(t, f, ["k"], insert_only=["tag"]))
    assert got == seq_strict(target, _feed(events), insert_only=["tag"])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(target=target_st, events=events_st)
def test_last_wins_matches_sequential(spark, target, events):
    t, f = _frames(spark, target, events)
    assert _rows(ch.apply_last_wins(t, f, ["k"])) == seq_last_wins(target, _feed(events))


def seq_outcomes(target, feed):
    live = set(target)
    out = []
    for lsn, seq, op, k, v, tag in sorted(feed, key=lambda r: (r[0], r[1])):
        if k is None:         # never matches a row
            out.append((lsn, seq, "failed" if op == 4 else "processed"))
            continue
        if op == 1:
            ok = True
            live.discard(k)
        elif op == 2:
            ok = k not in live
            live.add(k)
        elif op == 4:
            ok = k in live
        else:
            ok = True
        out.append((lsn, seq, "processed" if ok else "failed"))
    return sorted(out)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(target=target_st, events=events_st)
def test_outcomes_match_sequential(spark, target, events):
    t, f = _frames(spark, target, events)
    got = ch.strict_outcomes(f, t, ["k"], partitions=5).select("lsn", "seqval", "status").collect()
    assert sorted(tuple(r) for r in got) == seq_outcomes(target, _feed(events))


def test_hot_key_is_salted(spark):
    """A key holding most of the feed is spread over salt buckets."""
    rows = [(i, 0, 4 if i else 2, 7, i, f"t{i}") for i in range(200)] + [(500, 0, 2, 8, 1, "x")]
    f = spark.createDataFrame(rows, FEED)
    t = spark.createDataFrame([], SCHEMA)
    plan = ch.strict_decisions(f, ["k"], ["v", "tag"], hot_rows=20)
    assert "_salt" in plan._jdf.queryExecution().analyzed().toString()
    got = _rows(ch.apply_strict(t, f, ["k"], hot_rows=20))
    assert got == [(7, 199, "t199"), (8, 1, "x")]


def test_feed_range_and_bounds(spark):
    f = spark.createDataFrame(_feed([(1, 2, 1), (1, 3, 2), (2, 4, 3), (None, 1, 4)]), FEED)
    assert ch.feed_range(f, 0, 1).count() == 3          # op 3 excluded by 'all'
    assert ch.feed_range(f, 0, 1, "all update old").count() == 4
    assert ch.feed_range(f, 0, 1, exclusive_from=True).count() == 2
    b = ch.feed_bounds(f).first()
    assert (b["min_lsn"], b["max_lsn"]) == (0, 1)


def test_dimension_history(spark):
    f = spark.createDataFrame([(1, 0, 2, 5, 1, "a"), (2, 0, 4, 5, 2, "b"), (3, 0, 4, 6, 3, "c")], FEED) \
        .withColumn("change_time", F.timestamp_seconds(F.col("lsn")))
    rows = {r["lsn"]: r for r in ch.dimension_history(f, ["k"], columns=["lsn"]).collect()}
    assert rows[1]["is_current"] is False and rows[2]["is_current"] is True
    assert rows[3]["expiration_date"] is None
