"""Queries over signals, blocks, links, stories, integrity and the composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackfall.functions import signals as SG
from stackfall.functions.text import package_token
from stackfall.operators import blocks as B
from stackfall.operators import chunks as H
from stackfall.operators import integrity as Q
from stackfall.operators import known as N
from stackfall.operators import links as L
from stackfall.operators import signals as G
from stackfall.operators import stories as T
from stackfall.operators import views as V
from stackfall.plans import jobs as J
from stackfall.schema import AMS_LABEL
from stackfall.session import cut, scratch_path
from stackfall.sinks import exports as X
from stackfall.sources import devices as D

from .common import KEYS, joined, lines, of, records, sql, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def _evidence(spark, sf):
    return cut(G.evidence(records(spark, sf)), "evidence")


def _signals(spark, sf):
    return G.signals_of(_evidence(spark, sf))


def _events(spark, sf):
    return cut(B.live_crash_events(B.live_blocks(cut(records(spark, sf), "records"))), "events")


def _sessions(spark, sf):
    return of(spark, sf, "sessions")


def _profiles(spark, sf):
    return D.parse_profile(of(spark, sf, "profile"))


# --- signals and anomalies ----------------------------------------------------------------

_SIG = "device_serial, session_id, seq, line_index, kind, process, pid, uid, reason, crashing, ms"


@query("ams_signals", sql("sig", f"SELECT {_SIG} FROM sig"))
def _(spark, sf):
    return G.ams_signals(records(spark, sf)).select(*[c.strip() for c in _SIG.split(",")])


@query("ams_roles", sql("sig", """SELECT kind, kind IN ('amCrash', 'amAnr', 'isCrashing', 'anrIn') AS is_source, kind IN ('forceFinish', 'forceStop', 'killing', 'processDied', 'amProcDied') AS is_victim,
  count(*) AS n, count(*) FILTER (lower(coalesce(reason, '')) LIKE '%crash%' OR lower(coalesce(reason, '')) LIKE '%error%' OR lower(coalesce(reason, '')) LIKE '%anr%') AS n_crash_reason FROM sig GROUP BY ALL"""))
def _(spark, sf):
    kind = F.col("kind")
    return G.ams_signals(records(spark, sf)).groupBy(
        kind, SG.is_source(kind).alias("is_source"), SG.is_victim(kind).alias("is_victim")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(SG.is_crash_reason(F.col("reason"))).alias("n_crash_reason"),
    )


@query("first_package_token", sql("rec", r"SELECT device_serial, session_id, seq, regexp_extract(raw, '(?:^|[\s,{}/:])([A-Za-z][A-Za-z0-9._]*\.[A-Za-z0-9._]*)(?:$|[\s,{}/:])', 1) AS package FROM rec WHERE regexp_matches(raw, '(?:^|[\s,{}/:])([A-Za-z][A-Za-z0-9._]*\.[A-Za-z0-9._]*)(?:$|[\s,{}/:])')"))
def _(spark, sf):
    found = lines(spark, sf).select(*KEYS, "seq", package_token(F.col("line")).alias("package"))
    return found.where(F.col("package").isNotNull())


_ANOM = "device_serial, session_id, seq, line_index, kind, severity, process, pid, detail"


@query("anomalies", sql("anomaly", f"SELECT {_ANOM} FROM anomaly"))
def _(spark, sf):
    return G.anomalies(records(spark, sf)).select(*[c.strip() for c in _ANOM.split(",")])


@query("anomaly_counts", sql("anomaly", "SELECT device_serial, session_id, kind, severity, count(*) AS n FROM anomaly GROUP BY ALL"))
def _(spark, sf):
    return G.anomaly_counts(G.anomalies(records(spark, sf)))


# --- links ----------------------------------------------------------------------------


@query("signal_context", sql("links", """SELECT device_serial, session_id, seq, pos, at_ms, CASE WHEN src THEN 'source' WHEN kind IN ('forceFinish', 'forceStop', 'killing', 'processDied', 'amProcDied') THEN 'victim' END AS role,
  CASE WHEN src THEN coalesce(process, ctx.p) ELSE process END AS name, CASE WHEN src THEN coalesce(pid, ctx.i) ELSE pid END AS name_pid FROM g1"""))
def _(spark, sf):
    out = L.with_context(_signals(spark, sf))
    return out.select(*KEYS, "seq", "pos", "at_ms", "role", "name", "name_pid")


@query("victim_links", sql("links", "SELECT device_serial, session_id, pos, seq, source, source_pid, victim, victim_pid, victim_kind, gap_ms, source_line, victim_line, confirmed FROM vlink"))
def _(spark, sf):
    out = L.victim_links(_signals(spark, sf), keep=cut)
    return out.drop("source_detail", "source_seq")


_CLINK = "device_serial, session_id, source, source_pid, victim, victim_pid, confidence, gap_ms, source_line, victim_line"


@query("causal_links", sql("links", f"SELECT {_CLINK} FROM clink"))
def _(spark, sf):
    return L.link_deaths(_signals(spark, sf), keep=cut).select(*[c.strip() for c in _CLINK.split(",")])


@query("causal_links_by_ordinal", sql("links", """SELECT device_serial, session_id, pos, source, victim FROM pairs WHERE false""").replace(
    "SELECT device_serial, session_id, pos, source, victim FROM pairs WHERE false",
    """SELECT v.device_serial, v.session_id, v.pos, s.name AS source, v.process AS victim FROM vic v JOIN src s ON s.device_serial = v.device_serial AND s.session_id = v.session_id AND s.pos < v.pos AND s.name <> v.process
    AND v.pos - s.pos <= 3 AND (v.at_ms IS NULL OR s.at_ms IS NULL OR abs(v.at_ms - s.at_ms) <= 60000) QUALIFY row_number() OVER (PARTITION BY v.device_serial, v.session_id, v.pos ORDER BY s.pos DESC) = 1"""))
def _(spark, sf):
    out = L.victim_links(
        _signals(spark, sf), max_lines=3, max_gap_ms=60_000, line_window="signals", keep=cut
    )
    return out.select(*KEYS, "pos", "source", "victim")


_DID = "CASE v.kind " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in AMS_LABEL.items()) + " END"


@query("link_reasons", sql("links", f"""SELECT c.device_serial, c.session_id, c.source, c.victim, CASE WHEN c.gap_ms >= 0 THEN c.source || ' crashed; ' || c.gap_ms || ' ms later ' || c.victim || ' was ' || {_DID}
  WHEN c.gap_ms < 0 THEN c.victim || ' was ' || {_DID} || ' ' || -c.gap_ms || ' ms before ' || c.source || ' crashed' ELSE c.source || ' crashed; ' || c.victim || ' was ' || {_DID} END AS reason
  FROM clink c JOIN sig v ON v.device_serial = c.device_serial AND v.session_id = c.session_id AND v.line_index = c.victim_line"""))
def _(spark, sf):
    return L.link_deaths(_signals(spark, sf), keep=cut).select(*KEYS, "source", "victim", "reason")


@query("evidence_rows", sql("links", """SELECT c.device_serial, c.session_id, c.source, c.victim, e.n AS evidence_no, r.message FROM clink c, LATERAL (SELECT 0 AS n, c.source_line AS li UNION ALL SELECT 1, c.victim_line) e
  JOIN rec r ON r.device_serial = c.device_serial AND r.session_id = c.session_id AND r.line_index = e.li"""))
def _(spark, sf):
    r = cut(records(spark, sf), "records")
    found = L.link_deaths(G.signals_of(cut(G.evidence(r), "evidence")), keep=cut)
    out = L.evidence_rows(found, r)
    ends = (F.col("link_source").alias("source"), F.col("link_victim").alias("victim"))
    return out.select(*KEYS, *ends, "evidence_no", "message")


# --- blocks and events --------------------------------------------------------------------


@query("crash_blocks", sql("blk", "SELECT device_serial, session_id, seq, start_seq, line_no FROM blk"))
def _(spark, sf):
    return B.crash_blocks(lines(spark, sf)).select(*KEYS, "seq", "start_seq", "line_no")


_EVT = "device_serial, session_id, event_id, start_seq, kind, process, pid, thread, exception, message, frames, caused_by, n_lines, n_frames"
_EVT_COLS = [c.strip() for c in _EVT.split(",")]


@query("crash_events", sql("batch_events", f"SELECT {_EVT} FROM evt"))
def _(spark, sf):
    out = B.crash_events(B.crash_blocks(lines(spark, sf)))
    return out.withColumns({n: joined(n) for n in ("frames", "caused_by")}).select(*_EVT_COLS)


@query("live_blocks", sql("live", "SELECT device_serial, session_id, seq, start_seq, CASE WHEN start_seq IS NOT NULL THEN row_number() OVER (PARTITION BY device_serial, session_id, start_seq ORDER BY seq) - 1 END AS line_no FROM lrow"))
def _(spark, sf):
    return B.live_blocks(cut(records(spark, sf), "records")).select(*KEYS, "seq", "start_seq", "line_no")


@query("live_events", sql("live_events", f"SELECT {_EVT}, true AS complete FROM evt"))
def _(spark, sf):
    out = B.live_crash_events(B.live_blocks(cut(records(spark, sf), "records")))
    return out.withColumns({n: joined(n) for n in ("frames", "caused_by")}).select(*_EVT_COLS, "complete")


@query("live_signals", sql(("live", "sig", "anomaly"), """SELECT r.device_serial, r.session_id, r.seq, s.kind AS ams_kind, a.kind AS anomaly_kind FROM lrow r LEFT JOIN sig s ON s.seq = r.seq LEFT JOIN anomaly a ON a.seq = r.seq
  WHERE r.start_seq IS NULL AND (s.kind IS NOT NULL OR a.kind IS NOT NULL)"""))
def _(spark, sf):
    out = B.live_signals(B.live_blocks(cut(records(spark, sf), "records")))
    return out.select(*KEYS, "seq", F.col("ams.kind").alias("ams_kind"), F.col("anomaly.kind").alias("anomaly_kind"))


@query("fill_identity", sql("live_events", "SELECT e.device_serial, e.session_id, e.event_id, r.pid FROM evt e JOIN rec r ON r.seq = e.start_seq"))
def _(spark, sf):
    """Events that name no process take the pid of the stored row that opened them."""
    r = cut(records(spark, sf), "records")
    nameless = B.live_crash_events(B.live_blocks(r)).withColumn("pid", F.lit(None).cast("int"))
    opening = r.select(*KEYS, F.col("seq").alias("start_seq"), F.col("package").alias("_package"), F.col("pid").alias("_pid"))
    return B.fill_identity(nameless, opening).select(*KEYS, "event_id", "pid")


@query("group_crashes", sql("live_events", "SELECT device_serial, session_id, coalesce(exception, '') AS exception, n_frames, count(*) AS n, min(start_seq) AS first_seq FROM evt GROUP BY device_serial, session_id, coalesce(exception, ''), n_frames, frames"))
def _(spark, sf):
    return V.group_crashes(_events(spark, sf)).drop("stack_hash", "first_event")


@query("count_by_kind", sql("live_events", "SELECT device_serial, session_id, kind, count(*) AS n FROM evt GROUP BY ALL"))
def _(spark, sf):
    return V.count_by_kind(_events(spark, sf))


@query("fleet_crashes", sql("live_events", "SELECT device_serial, kind, count(*) AS n FROM evt GROUP BY CUBE (device_serial, kind)"))
def _(spark, sf):
    return V.fleet_crashes(_events(spark, sf))


@query("cap_events", sql("live_events", "SELECT device_serial, session_id, event_id FROM evt QUALIFY row_number() OVER (PARTITION BY device_serial, session_id ORDER BY start_seq DESC) <= 4"))
def _(spark, sf):
    return V.cap_events(_events(spark, sf), 4).select(*KEYS, "event_id")


@query("first_events", sql("live_events", "SELECT device_serial, session_id, event_id FROM evt QUALIFY row_number() OVER (PARTITION BY device_serial, session_id ORDER BY start_seq) <= 4"))
def _(spark, sf):
    return V.cap_events(_events(spark, sf), 4, newest=False).select(*KEYS, "event_id")


@query("snapshot", sql("live_events", "SELECT device_serial, session_id, event_id, 1 AS version FROM evt"))
def _(spark, sf):
    path = scratch_path(spark, "snapshot")
    X.save_snapshot(_events(spark, sf), path, 1_704_067_200_000)
    return D.load_snapshot(spark, path).select(*KEYS, "event_id", "version")


@query("settle", sql("live_events", "SELECT device_serial, session_id, event_id, n_lines FROM evt"))
def _(spark, sf):
    """Every growth state of a block as an update; only the last one stays."""
    rows = B.live_blocks(cut(records(spark, sf), "records")).where(F.col("start_seq").isNotNull())
    updates = rows.select(
        *KEYS, F.concat(F.lit("crashBuffer#"), F.col("start_seq")).alias("event_id"),
        F.col("seq").alias("version"), (F.col("line_no") + 1).alias("n_lines"),
    )
    return V.settle(updates).drop("version")


@query("timeline_order", sql("live_events", "SELECT row_number() OVER (ORDER BY device_serial, session_id, start_seq, event_id) - 1 AS position, device_serial || ' ' || session_id || ' ' || event_id AS line FROM evt"))
def _(spark, sf):
    """Events written in capture order; the lines of the files, one file after the other, keep it."""
    path = scratch_path(spark, "timeline")
    line = F.concat_ws(" ", *KEYS, "event_id")
    X.write_ordered(_events(spark, sf), path, [*KEYS, "start_seq", "event_id"], line)
    return X.read_ordered(spark, path)


@query("story_order", sql("stories", "SELECT row_number() OVER (ORDER BY device_serial, session_id, first_line NULLS LAST, identity) - 1 AS position, device_serial || ' ' || session_id || ' ' || identity AS line FROM story"))
def _(spark, sf):
    """Stories of a session by first line, those without one last."""
    path = scratch_path(spark, "stories")
    order = [*KEYS, F.col("first_line").asc_nulls_last(), "identity"]
    X.write_ordered(_correlated(spark, sf)[0].stories, path, order, F.concat_ws(" ", *KEYS, "identity"))
    return X.read_ordered(spark, path)


@query("timeline_groups", sql("live_events", "SELECT device_serial, session_id, 'crashBuffer' AS origin, count(*) AS n FROM (SELECT DISTINCT device_serial, session_id, coalesce(exception, '') AS x, frames FROM evt) GROUP BY device_serial, session_id"))
def _(spark, sf):
    events = _events(spark, sf).withColumn("version", F.col("start_seq"))
    return J.timeline(events).tabs


@query("known_notes", sql("live_events", """SELECT device_serial, session_id, event_id, CASE WHEN contains(hay, 'Cannot initialize effect engine for type:') THEN 'Sound effect unavailable' WHEN contains(hay, 'java.lang.OutOfMemoryError') THEN 'Java heap exhausted' ELSE 'Oversized binder call' END AS title
  FROM (SELECT *, concat_ws(chr(10), exception, message) AS hay FROM evt) WHERE contains(hay, 'Cannot initialize effect engine for type:') OR contains(hay, 'java.lang.OutOfMemoryError') OR contains(hay, 'TransactionTooLargeException')"""))
def _(spark, sf):
    return N.known_notes(_events(spark, sf)).select(*KEYS, "event_id", "title")


@query("known_causes", sql("live_events", """SELECT device_serial, session_id, title, count(*) AS n, min(start_seq) AS first_seq FROM (SELECT *, CASE WHEN contains(hay, 'Cannot initialize effect engine for type:') THEN 'Sound effect unavailable' WHEN contains(hay, 'java.lang.OutOfMemoryError') THEN 'Java heap exhausted'
  WHEN contains(hay, 'TransactionTooLargeException') THEN 'Oversized binder call' END AS title FROM (SELECT *, concat_ws(chr(10), exception, message) AS hay FROM evt)) WHERE title IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    return N.known_causes(N.known_notes(_events(spark, sf))).drop("cause", "action")


#: One signature per customer; several may fit a line, the smallest key counts.
_NEEDLE = "'com.app' || CAST({c} % 5 AS {s}) || '.main'' (' || CAST(2000 + {c} % 300 AS {s}) || ')'"


@query("user_signatures", sql("rec", f"""SELECT device_serial, session_id, seq, min(c_custkey) AS priority, arg_min(c_name, c_custkey) AS title FROM rec
  JOIN (SELECT c_custkey, c_name, {_NEEDLE.format(c="c_custkey", s="VARCHAR")} AS needle FROM customer) g ON contains(rec.message, g.needle) GROUP BY ALL"""))
def _(spark, sf):
    """As many signatures as customers, looked up in all messages."""
    signatures = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("priority"), F.expr(_NEEDLE.format(c="c_custkey", s="STRING").replace("''", "\\'")).alias("needle"),
        F.col("c_name").alias("title"),
    )
    rows = cut(records(spark, sf).select(*KEYS, "seq", "message"), "messages")
    return N.first_signature(rows, ["message"], signatures).select(*KEYS, "seq", "priority", "title")


@query("stored_ordinals", sql("sig", f"SELECT {_SIG} FROM sig"))
def _(spark, sf):
    """Signals of stored records, placed by the rank structure stored beside them."""
    base = scratch_path(spark, "stored")
    X.write_records(records(spark, sf), base + "/records")
    stored = spark.read.parquet(base + "/records")
    X.write_ranks(stored, base + "/ranks")
    found = G.ams_signals(stored, ranks=X.read_ranks(spark, base + "/ranks"))
    return found.select(*[c.strip() for c in _SIG.split(",")])


# --- stories ----------------------------------------------------------------------------


def _correlated(spark, sf):
    r = cut(records(spark, sf), "records")
    found = cut(G.evidence(r), "evidence")
    signals = G.signals_of(found)
    events = cut(B.live_crash_events(B.live_blocks(r)), "events")
    links = cut(L.link_deaths(signals, keep=cut), "links")
    return T.correlate(events, signals, links), found, events, links


_STORY = "device_serial, session_id, identity, uid, n_crashes, n_episodes, restarts, n_victims, first_line, last_line"


@query("stories", sql("stories", f"SELECT {_STORY} FROM story"))
def _(spark, sf):
    return _correlated(spark, sf)[0].stories


@query("top_stories", sql("stories", f"SELECT {_STORY} FROM story WHERE n_crashes > 0 OR n_victims > 0 ORDER BY n_crashes DESC, first_line NULLS LAST, device_serial, session_id, identity LIMIT 50"))
def _(spark, sf):
    return T.top_stories(_correlated(spark, sf)[0].stories, 50)


@query("identify", sql("stories", "SELECT device_serial, session_id, event_id, identity, position FROM placed"))
def _(spark, sf):
    r = cut(records(spark, sf), "records")
    signals = G.ams_signals(r)
    events = B.live_crash_events(B.live_blocks(r))
    return T.identify(events, cut(signals, "signals")).select(*KEYS, "event_id", "identity", "position")


@query("episodes", sql("stories", "SELECT device_serial, session_id, identity, pid, first_line, last_line, started FROM episode"))
def _(spark, sf):
    return _correlated(spark, sf)[0].episodes


@query("story_victims", sql("stories", "SELECT c.device_serial, c.session_id, c.source AS identity, c.victim, c.confidence FROM clink c SEMI JOIN owned o ON c.device_serial = o.device_serial AND c.session_id = o.session_id AND c.source = o.identity"))
def _(spark, sf):
    return _correlated(spark, sf)[0].victims.select(*KEYS, "identity", "victim", "confidence")


@query("correlation_counts", sql("stories", """SELECT device_serial, session_id, coalesce(a, 0) AS unlinked_events, coalesce(b, 0) AS unlinked_links FROM (SELECT device_serial, session_id, count(*) FILTER (identity IS NULL) AS a FROM placed GROUP BY ALL)
  FULL JOIN (SELECT device_serial, session_id, count(*) AS b FROM clink c ANTI JOIN owned o ON c.device_serial = o.device_serial AND c.session_id = o.session_id AND c.source = o.identity GROUP BY ALL) USING (device_serial, session_id)"""))
def _(spark, sf):
    return _correlated(spark, sf)[0].counts


_ATTACHED = """SELECT a.device_serial, a.session_id, s.identity, a.seq, a.kind FROM anomaly a JOIN story s USING (device_serial, session_id)
  WHERE a.process = s.identity OR EXISTS (SELECT 1 FROM episode e WHERE e.device_serial = a.device_serial AND e.session_id = a.session_id AND e.identity = s.identity AND e.pid = a.pid)"""


@query("story_anomalies", sql(("stories", "anomaly"), _ATTACHED))
def _(spark, sf):
    story, found, _, _ = _correlated(spark, sf)
    out = T.attach_anomalies(G.anomalies_of(found), cut(story.stories, "stories"), cut(story.episodes, "episodes"))
    return out.by_story.select(*KEYS, "identity", "seq", "kind")


@query("unattached_anomalies", sql(("stories", "anomaly"), f"SELECT a.device_serial, a.session_id, count(*) FILTER (t.seq IS NULL) AS unattached FROM anomaly a LEFT JOIN (SELECT DISTINCT seq FROM ({_ATTACHED})) t ON t.seq = a.seq GROUP BY ALL"))
def _(spark, sf):
    story, found, _, _ = _correlated(spark, sf)
    return T.attach_anomalies(G.anomalies_of(found), story.stories, story.episodes).unattached


# --- integrity --------------------------------------------------------------------------


@query("stackless_crashes", sql("live_events", "SELECT device_serial, session_id, count(*) AS crashes, count(*) FILTER (n_frames = 0) AS stackless FROM evt GROUP BY ALL"))
def _(spark, sf):
    return Q.stackless_crashes(_events(spark, sf))


@query("missing_buffers", sql("checks", "SELECT device_serial, session_id, array_to_string(list_sort(r), ',') AS requested, CASE WHEN missing IS NOT NULL THEN array_to_string(list_sort(missing), ',') END AS missing FROM buf"))
def _(spark, sf):
    out = Q.missing_buffers(_sessions(spark, sf), _profiles(spark, sf))
    names = {n: F.array_sort(n) for n in ("requested", "missing")}
    return out.withColumns(names).select(*KEYS, joined("requested", ","), joined("missing", ","))


def _checks(spark, sf):
    r = cut(records(spark, sf, timed=True), "records")
    events = B.live_crash_events(B.live_blocks(r))
    return Q.assess_integrity(
        _sessions(spark, sf), Q.capture_counters(r), Q.gap_summary(Q.gaps(r)),
        Q.stackless_crashes(events), Q.missing_buffers(_sessions(spark, sf), _profiles(spark, sf)),
    )


@query("integrity", sql("checks", "SELECT * FROM checks"))
def _(spark, sf):
    return _checks(spark, sf).select(*KEYS, "id", "status", "value")


@query("worst_checks", sql("checks", "SELECT device_serial, session_id, id, CASE status WHEN 'warning' THEN 2 WHEN 'notice' THEN 1 ELSE 0 END AS status_rank FROM checks WHERE status <> 'ok'"))
def _(spark, sf):
    return Q.worst_first(_checks(spark, sf)).where(F.col("status") != "ok").select(*KEYS, "id", "status_rank")


# --- composite --------------------------------------------------------------------------


def forensics(spark, sf) -> J.Forensics:
    r = cut(records(spark, sf, timed=True), "records")
    return J.analyse(r, cut(_sessions(spark, sf), "sessions"), profiles=_profiles(spark, sf))


@query("forensics_summary", sql(("stories", "anomaly", "checks"), """SELECT s.device_serial, s.session_id, coalesce(p, 0) AS processes, coalesce(c, 0) AS crashes, coalesce(l, 0) AS links, coalesce(a, 0) AS anomalies, coalesce(w, 0) AS warnings FROM sess s
  LEFT JOIN (SELECT device_serial, session_id, count(*) AS p, CAST(sum(n_crashes) AS BIGINT) AS c FROM story GROUP BY ALL) USING (device_serial, session_id)
  LEFT JOIN (SELECT device_serial, session_id, count(*) AS l FROM clink GROUP BY ALL) USING (device_serial, session_id)
  LEFT JOIN (SELECT device_serial, session_id, count(*) AS a FROM anomaly GROUP BY ALL) USING (device_serial, session_id)
  LEFT JOIN (SELECT device_serial, session_id, count(*) AS w FROM checks WHERE status = 'warning' GROUP BY ALL) USING (device_serial, session_id)"""))
def _(spark, sf):
    return forensics(spark, sf).summary


@query("forensics_sql", sql(("stories",), """SELECT s.device_serial, s.session_id, s.identity, l.victim, s.n_crashes FROM story s JOIN clink l ON l.device_serial = s.device_serial AND l.session_id = s.session_id AND l.source = s.identity WHERE l.confidence = 'confirmed'"""))
def _(spark, sf):
    """Plain SQL over the registered views."""
    forensics(spark, sf).register(spark, "fx_")
    return spark.sql(
        "SELECT s.device_serial, s.session_id, s.identity, l.victim, s.n_crashes FROM fx_stories s JOIN fx_links l "
        "ON l.device_serial = s.device_serial AND l.session_id = s.session_id AND l.source = s.identity WHERE l.confidence = 'confirmed'"
    )


@query("rank_of_lines", sql("sig", "SELECT device_serial, session_id, seq, line_index FROM sig"))
def _(spark, sf):
    all_lines = lines(spark, sf)
    few = all_lines.where(SG.may_be_ams(F.col("line"))).select(*KEYS, "seq")
    return H.rank_of(few, all_lines.select(*KEYS, "seq"))
