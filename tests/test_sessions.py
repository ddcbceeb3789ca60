"""Ordered operators: one giant session in tiny chunks must give what a plain loop gives."""

import random

import pytest
from pyspark.sql import functions as F

from stackfall.operators import blocks as B
from stackfall.operators import chunks as H
from stackfall.operators import identity as I
from stackfall.operators import integrity as Q
from stackfall.operators import links as L
from stackfall.operators import views as V

KEYS = "device_serial string, session_id string, seq bigint"


def seqs(n, rng):
    return sorted(rng.sample(range(n * 3), n))


@pytest.mark.parametrize("chunk", [3, 50, 1 << 18])
def test_batch_blocks_match_a_loop(spark, chunk):
    rng = random.Random(chunk)
    stamp = "09-30 12:00:00.123  1  1 E "
    pool = [stamp + "T: FATAL EXCEPTION: main", stamp + "T: same tag", stamp + "U: other tag", stamp + "U: \tat a.b(C.java:1)",
            "Caused by: x", "#00 pc", stamp + "T : padded"]
    rows = []
    for session in ("s", "t"):
        rows += [("d", session, q, rng.choice(pool)) for q in seqs(250, rng)]
    df = spark.createDataFrame(rows, KEYS + ", line string")
    got = {(r.session_id, r.seq): (r.start_seq, r.line_no) for r in B.crash_blocks(df, chunk_rows=chunk).collect()}
    want, open_ = {}, {}
    for _, s, q, line in rows:
        tag = "T" if " T: " in line else "U" if " U: " in line else None
        if "FATAL" in line:
            open_[s] = [q, "T", 0]
        elif s not in open_:
            continue
        elif not (tag == open_[s][1] or "\tat " in line or line.startswith(("Caused", "#"))):
            del open_[s]
            continue
        want[(s, q)] = (open_[s][0], open_[s][2])
        open_[s][2] += 1
    assert got == want


def test_block_over_many_chunks_and_long_blocks(spark):
    n = 300
    lines = ["09-30 12:00:00.123  1  1 E T: FATAL EXCEPTION: main"] + [f"\tat a.b(C.java:{i})" for i in range(n)]
    df = spark.createDataFrame([("d", "s", i, x) for i, x in enumerate(lines)], KEYS + ", line string")
    blocks = B.crash_blocks(df, chunk_rows=16)
    whole = B.crash_events(blocks).first()
    assert whole.n_lines == n + 1 and whole.n_frames == n and len(whole.frames) == n and whole.thread == "main"
    assert len(whole.raw) == n + 1
    long = B.crash_events(blocks, arrays=False).first()
    assert long.frames is None and long.n_frames == n and long.stack_hash == whole.stack_hash and long.kind == "nativeCrash"


def test_live_blocks_have_no_length_limit(spark):
    rows = [("d", "s", 0, "AndroidRuntime", "FATAL EXCEPTION: main", "p", 1)]
    rows += [("d", "s", i, "AndroidRuntime", f"at a.b{i}(C)", None, 1) for i in range(1, 5_000)]
    df = spark.createDataFrame(rows, KEYS + ", tag string, message string, package string, pid int")
    out = B.live_blocks(df, chunk_rows=64)
    assert out.where("start_seq = 0").count() == 5_000
    event = B.live_crash_events(out, finish=False).first()
    assert event.n_lines == len(event.raw) == 5_000 and not event.complete and event.process == "p"


def brute_links(signals, max_lines, max_gap):
    """The rules as a plain loop (with midnights counted on the raw clock)."""
    sources, crashed, current, prev, days, out = [], set(), None, None, 0, []
    for pos, s in enumerate(signals):
        at = None
        if s["ms"] is not None:
            if prev is not None and s["ms"] + 60_000 < prev:
                days += 1
            prev = s["ms"]
            at = s["ms"] + days * 86_400_000
        if s["kind"] in ("amCrash", "isCrashing") and s["crashing"] is not False:
            name = s["process"] or (current and current[0])
            if name:
                crashed.add(name)
                sources.append((name, s["line_index"], at, pos))
            continue
        if s["process"]:
            current = (s["process"], s["pid"])
        if s["kind"] not in ("killing", "forceFinish") or not s["process"]:
            continue
        sources = [x for x in sources if max(pos - x[1], 0) <= max_lines and (at is None or x[2] is None or abs(at - x[2]) <= max_gap)]
        for x in reversed(sources):
            if x[0] != s["process"] and s["process"] not in crashed:
                out.append((pos, x[0], s["process"], x[3]))
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_match_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, ms = [], 86_300_000
    for i, q in enumerate(seqs(400, rng)):
        ms += rng.choice([0, 100, 900, 2_500])
        kind = rng.choice(["isCrashing", "amCrash", "processRecord", "killing", "forceFinish", "amKill"])
        crash = kind in ("isCrashing", "amCrash")
        process = rng.choice("abc") if crash else rng.choice("abcdefgh")
        if rng.random() < 0.2:
            process = None
        rows.append(dict(device_serial="d", session_id="s", seq=q, line_index=i // 2, kind=kind, process=process, pid=i, uid=None,
                         reason=rng.choice([None, "crash"]), crashing=rng.choice([None, True, False]) if kind == "isCrashing" else None,
                         detail=None, ms=None if rng.random() < 0.15 else ms % 86_400_000))
    df = spark.createDataFrame(rows, KEYS + ", line_index bigint, kind string, process string, pid int, uid int, reason string, crashing boolean, detail string, ms bigint")
    for max_lines, gap in ((60, 5_000), (250, 1_000)):
        found = L.victim_links(df, max_lines=max_lines, max_gap_ms=gap, chunk_rows=40)
        got = sorted((r.pos, r.source, r.victim) for r in found.collect())
        assert got == sorted(w[:3] for w in brute_links(rows, max_lines, gap))


def test_repeat_links_keep_first_pids_and_last_confirmed_proof(spark):
    cols = KEYS + ", pos bigint, source string, source_pid int, victim string, victim_pid int, victim_kind string, gap_ms bigint, source_detail string, source_line bigint, victim_line bigint, source_seq bigint, confirmed boolean"
    rows = [("d", "s", q, q, "a", q, "b", q + 1, "killing", 10 * q, None, q, q + 5, q, c) for q, c in ((1, False), (2, True), (3, True), (4, False))]
    one = L.merge_links(spark.createDataFrame(rows, cols)).first()
    assert (one.source_pid, one.victim_pid, one.confidence, one.evidence) == (1, 2, "confirmed", [3, 8])
    assert one.reason == "a crashed; 30 ms later b was killed"


def test_scan_rank_and_tail(spark):
    rng = random.Random(5)
    rows = [("d", s, q, rng.choice([None, q])) for s in "xy" for q in seqs(500, rng)]
    df = spark.createDataFrame(rows, KEYS + ", v bigint")
    out = H.scan(df, last={"prev": F.col("v")}, count={"n": F.col("v").isNotNull().cast("int")}, before=True, chunk_rows=17)
    got = {(r.session_id, r.seq): (r.prev, r.n) for r in out.collect()}
    state = {"x": (None, 0), "y": (None, 0)}
    for _, s, q, v in rows:
        assert got[(s, q)] == state[s]
        if v is not None:
            state[s] = (v, state[s][1] + 1)
    few = df.where("v is not null")
    order = {}
    for _, s, q, _ in rows:
        order[(s, q)] = len([1 for k in order if k[0] == s])
    assert all(order[(r.session_id, r.seq)] == r.line_index for r in H.rank_of(few, df).collect())
    kept = {(r.session_id, r.seq) for r in V.tail(df, 33, chunk_rows=20).collect()}
    assert kept == {k for k, i in order.items() if i >= 500 - 33}


def test_gap_baseline_moves_back(spark):
    rows = [("d", "s", i, f"2024-01-01 00:00:{t:02d}") for i, t in enumerate((10, 11, 5, 45))]
    df = spark.createDataFrame(rows, KEYS + ", t string").withColumn("device_ts", F.col("t").cast("timestamp_ntz"))
    assert [r.gap_ms for r in Q.gaps(df, chunk_rows=2).orderBy("seq").collect()] == [1_000, 40_000]


def test_incremental_lines_keep_repeats_within_a_poll(spark):
    rows = [("d", 0, 0, "a"), ("d", 0, 1, "b"), ("d", 1, 0, "b"), ("d", 1, 1, "c"), ("d", 1, 2, "c"), ("d", 2, 0, "a")]
    df = spark.createDataFrame(rows, "device_serial string, poll_no bigint, line_no bigint, line string")
    assert sorted((r.poll_no, r.line) for r in V.incremental_lines(df).collect()) == [(0, "a"), (0, "b"), (1, "c"), (1, "c"), (2, "a")]


def test_rank_structure_counts_rows_over_gaps_and_chunks(spark):
    import random

    r = random.Random(7)
    seqs = sorted(r.sample(range(600_000), 700) + [63, 64, 127, 128, 262_143, 262_144])
    seqs = sorted(set(seqs))
    df = spark.createDataFrame([("d", "s", q) for q in seqs] + [("d", "t", q) for q in seqs[::3]], KEYS)
    ranks = H.line_ranks(df)
    got = {(x.session_id, x.seq): x.line_index for x in H.place_in(df, ranks).collect()}
    assert got == {("s", q): i for i, q in enumerate(seqs)} | {("t", q): i for i, q in enumerate(seqs[::3])}
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("chunk_ms", [7, 1000, 10**9])
def test_package_as_of_by_spans(spark, chunk_ms):
    import random

    r = random.Random(2)
    polls = [("d", p, t, f"com.a{r.randrange(3)}:x" if r.random() < 0.8 else "init") for p in (1, 2, 3) for t in r.sample(range(200), 25)]
    rows = [("d", "s", i, r.choice([1, 1, 1, 1, 2, 4, None]), r.choice([None, *range(-5, 220)]), None, i) for i in range(800)]
    ps = spark.createDataFrame(polls, "device_serial string, pid int, polled_at_ms bigint, name string")
    records = spark.createDataFrame(rows, KEYS + ", pid int, received_at_ms bigint, package string, _span int")
    found = {x.seq: x.package for x in I.with_package(records, ps, chunk_ms=chunk_ms).collect()}
    for _, _, seq, pid, at, _, _ in rows:
        known = [(t, n) for _, p, t, n in polls if p == pid and at is not None and t <= at]
        name = max(known)[1] if known else None
        want = None if name in (None, "init") else name.split(":")[0]
        assert found[seq] == want, (seq, pid, at)
    assert len(found) == len(rows)


def test_many_signatures_equal_a_loop(spark):
    import random

    from stackfall.operators import known as N

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 7)))
    texts = [" ".join(word() for _ in range(r.randint(0, 9))) for _ in range(150)] + [None, ""]
    needles = [(i, word() + r.choice(["", " " + word()]), f"t{i}", "c", "a") for i in range(400)] + [(0, "", "e", "c", "a"), (1, None, "n", "c", "a")]
    events = [("d", "s", i, f"e{i}", i, r.choice(texts), r.choice(texts), "x") for i in range(200)]
    df = spark.createDataFrame(events, KEYS + ", event_id string, start_seq bigint, exception string, message string, title string")
    signatures = spark.createDataFrame(needles, "priority int, needle string, title string, cause string, action string")
    got = {x.event_id: x.title for x in N.known_notes(df.drop("title"), signatures=signatures).collect()}
    want = {}
    for _, _, _, event, _, one, two, _ in events:
        hits = [(p, n, t) for p, n, t, *_ in needles if n and (n in (one or "") or n in (two or ""))]
        if hits:
            want[event] = min(hits)[2]
    assert got == want
    small = N.known_notes(df.drop("title"), extra=(("ab", "own", "c", "a"),))
    assert {x.event_id for x in small.collect()} == {e[3] for e in events if "ab" in (e[5] or "") or "ab" in (e[6] or "")}
