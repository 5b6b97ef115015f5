"""Queries on event logs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora import fixtures
from lexora.constants import SAVE_SECONDS, TAP_SECONDS
from lexora.operators import events as ev
from lexora.plans.registry import longs, query, table
from lexora.shared import cut, fresh
from lexora.sources import stores
from lexora.streaming import stateful

HOURS = 12
WORDS = ["我", "大学", "没有", "生活", "长", "虚", "国", "绿"]
KNOWN = [any(w in (e[1], e[2]) for e in fixtures.ENTRIES) for w in WORDS]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.timed(table(spark, sf_dir, "events")).withColumn("k", F.coalesce(k, F.lit(0).cast("long")))


def _word():
    i = (F.col("k") % len(WORDS)).cast("int")
    return F.get(F.array(*map(F.lit, WORDS)), i), F.get(F.array(*map(F.lit, KNOWN)), i)


_KIND = {"view": "open", "click": "push", "error": "pop", "signup": "close", "purchase": "tap"}


def _kind():
    out = F.lit(None).cast("string")
    for a, b in _KIND.items():
        out = F.when(F.col("event_type") == a, F.lit(b)).otherwise(out)
    return out


_L = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_K = "[" + ", ".join(str(x).lower() for x in KNOWN) + "]"
EV = f"""ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, coalesce(CAST(props->>'$.k' AS BIGINT), 0) AS k FROM events),
evw AS (SELECT *, ({_L})[1 + k % {len(WORDS)}] AS word, ({_K})[1 + k % {len(WORDS)}] AS found FROM ev)"""


def _throttle_sql(seconds: float) -> str:
    return f"""WITH RECURSIVE {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM ev),
f AS (SELECT user_id, rn, us, event_id, us AS last, true AS kept FROM n WHERE rn = 1
      UNION ALL SELECT n.user_id, n.rn, n.us, n.event_id, CASE WHEN n.us - f.last > {round(seconds * 1e6)} THEN n.us ELSE f.last END, n.us - f.last > {round(seconds * 1e6)}
      FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT user_id, us, event_id FROM f WHERE kept"""


@query(_throttle_sql(HOURS * 3600))
def throttle_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.throttled(_events(spark, sf_dir), "user_id", HOURS * 3600)


@query(_throttle_sql(SAVE_SECONDS))
def throttle_locations_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.throttled(_events(spark, sf_dir), "user_id", SAVE_SECONDS)


@query(f"""WITH {EV}, k AS ({_throttle_sql(HOURS * 3600).replace('WITH RECURSIVE ' + EV + ', ', 'WITH RECURSIVE ')})
SELECT user_id, max(us) AS us, arg_max(event_id, us) AS event_id FROM k GROUP BY user_id""")
def last_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert by key leaves of the saved locations."""
    kept = ev.throttled(_events(spark, sf_dir), "user_id", HOURS * 3600)
    return kept.groupBy("user_id").agg(F.max("us").alias("us"), F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))


@query(f"WITH {EV}, l AS (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) SELECT user_id, event_id, event_type FROM l WHERE rn = 1 OR b IS DISTINCT FROM event_type")
def distinct_until_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.changed(_events(spark, sf_dir), "user_id", "event_type").select("user_id", "event_id", "event_type")


_HITS = f"""WITH {EV}, h AS (SELECT user_id, event_id, us, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN '' ELSE word END AS hit FROM evw WHERE event_type <> 'purchase'),
l AS (SELECT *, lag(hit) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM h)
SELECT user_id, event_id, us, hit FROM l WHERE coalesce(hit, '') <> '' AND (coalesce(before, '') = '' OR before <> hit)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases aren't hits, errors are empty ones, signups clear."""
    word, _ = _word()
    e = _events(spark, sf_dir).where("event_type <> 'purchase'")
    return ev.hits(e, "user_id", F.when(F.col("event_type") == "error", "").otherwise(word), F.col("event_type") == "signup").select("user_id", "event_id", "us", "hit")


@query(f"SELECT user_id, event_id, hit FROM ({_HITS})")
def hits_until_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that differ from the one in force; after an empty hit or a clear the same one counts anew."""
    return _hits(spark, sf_dir).select("user_id", "event_id", "hit")


@query(f"SELECT user_id, event_id, us, hit FROM ({_HITS})")
def hits_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits handed on batch by batch to a receiver, which keeps each under its number."""
    base = fresh(spark, "published")
    cut(_hits(spark, sf_dir), "hits").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("user_id long, event_id long, us long, hit string").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    stores.published(stream, lambda rows, number: rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}"), f"{base}/state")
    return spark.read.schema("user_id long, event_id long, us long, hit string").parquet(f"{base}/out").select("user_id", "event_id", "us", "hit")


@query(f"WITH {EV} SELECT user_id, arg_max(word, struct_pack(us, event_id)) AS run FROM evw WHERE event_type IN ('view', 'click') GROUP BY user_id")
def last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that each user last touched, by views and clicks."""
    word, _ = _word()
    return ev.last_runs(_events(spark, sf_dir), "user_id", F.when(F.col("event_type").isin("view", "click"), word)).select("user_id", "run")


def _tap_sql(seconds: float) -> str:
    return f"""WITH {EV}, p AS (SELECT user_id, event_id, us, event_type, max(CASE WHEN event_type = 'view' THEN us END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS press_us FROM ev WHERE event_type IN ('view', 'purchase')),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, press_us ORDER BY us, event_id) AS nth FROM p WHERE event_type = 'purchase')
SELECT user_id, event_id, press_us, coalesce(us - press_us < {round(seconds * 1e6)} AND nth = 1, false) AS suppressed FROM t"""


def _taps(spark: SparkSession, sf_dir: str, seconds: float) -> DataFrame:
    out = ev.taps(_events(spark, sf_dir), "user_id", F.col("event_type") == "view", F.col("event_type") == "purchase", seconds)
    return out.select("user_id", "event_id", "press_us", "suppressed")


@query(_tap_sql(2 * 3600))
def tap_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taps(spark, sf_dir, 2 * 3600)


@query(_tap_sql(TAP_SECONDS))
def tap_suppression_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taps(spark, sf_dir, TAP_SECONDS)


@query(f"""WITH {EV}, g AS (SELECT user_id, event_id, us, CASE event_type WHEN 'view' THEN 'began' WHEN 'click' THEN 'changed' WHEN 'error' THEN 'ended' END AS state, CASE WHEN found THEN word END AS hit FROM evw WHERE event_type IN ('view', 'click', 'error')),
m AS (SELECT *, last_value(CASE WHEN state <> 'ended' THEN {{'h': hit}} END IGNORE NULLS) OVER w AS cur, last_value(CASE WHEN state = 'ended' THEN us END IGNORE NULLS) OVER w AS ended_us FROM g WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, state, state <> 'ended' AS frozen, cur.h AS current, state = 'ended' AND cur.h IS NULL AS emits_empty, ended_us FROM m""")
def gesture_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    word, found = _word()
    state = F.when(F.col("event_type") == "view", "began").when(F.col("event_type") == "click", "changed").when(F.col("event_type") == "error", "ended")
    out = ev.gestures(_events(spark, sf_dir), "user_id", state, F.when(found, word))
    return out.select("user_id", "event_id", "state", "frozen", "current", "emits_empty", "ended_us")


@query(f"""WITH {EV}, r AS (SELECT *, sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS done FROM ev WHERE event_type IN ('view', 'signup'))
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, done ORDER BY us, event_id) = 1 AS accepted FROM r WHERE event_type = 'view'""")
def single_flight_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.single_flight(_events(spark, sf_dir), "user_id", F.col("event_type") == "view", F.col("event_type") == "signup")
    return out.select("user_id", "event_id", "accepted")


_NAV = f"""WITH RECURSIVE {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM evw),
z AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, []::VARCHAR[] AS stack FROM n),
f AS (SELECT * FROM z UNION ALL SELECT n.user_id, n.rn, n.event_id, CASE
        WHEN n.event_type = 'signup' THEN []::VARCHAR[]
        WHEN n.event_type = 'view' AND n.found THEN [n.word]
        WHEN n.event_type = 'click' AND n.found THEN list_append(f.stack, n.word)
        WHEN n.event_type = 'error' THEN f.stack[1:greatest(len(f.stack) - 1, 0)] ELSE f.stack END
      FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT user_id, event_id, CAST(len(stack) AS BIGINT) AS depth, stack[len(stack)] AS top, len(stack) > 1 AS can_go_back FROM f WHERE rn > 0"""


@query(_NAV)
def nav_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    word, found = _word()
    return longs(ev.navigation(_events(spark, sf_dir), "user_id", _kind(), word, found).select("user_id", "event_id", "depth", "top", "can_go_back"), "depth")


@query(f"WITH {EV}, l AS (SELECT user_id, event_type, k, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rn FROM ev) SELECT user_id, event_type FROM l WHERE rn = 1")
def latest_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest(_events(spark, sf_dir), "user_id", "event_type")


@query(f"""WITH {EV}, m AS (SELECT *, CASE WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'system' ELSE 'custom' END END AS mode FROM ev),
l AS (SELECT *, coalesce(last_value(mode IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 'custom') AS now FROM m)
SELECT user_id, event_id FROM l WHERE mode IS NULL AND now = 'custom'""")
def mode_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events while the mode in force is the custom one; signups change it."""
    mode = F.when(F.col("event_type") == "signup", F.when(F.col("k") % 2 == 0, "system").otherwise("custom"))
    return ev.gated(_events(spark, sf_dir), "user_id", mode, "custom").select("user_id", "event_id")


@query(_NAV.replace("WHEN n.event_type = 'signup' THEN", "WHEN n.event_type IN ('signup', 'purchase') THEN").replace("SELECT user_id, event_id, CAST(len(stack) AS BIGINT) AS depth, stack[len(stack)] AS top, len(stack) > 1 AS can_go_back FROM f WHERE rn > 0", """
, d AS (SELECT f.user_id, f.event_id, f.rn, len(stack) AS depth, stack[len(stack)] AS top, coalesce(lag(len(stack)) OVER (PARTITION BY f.user_id ORDER BY f.rn), 0) AS before, n.event_type FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn WHERE f.rn > 0)
SELECT user_id, event_id, CAST(depth AS BIGINT) AS depth, top, sum(CAST(event_type = 'purchase' AND before = 0 AS INT)) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) % 2 = 1 AS chrome FROM d"""))
def reader_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups move to another place, purchases tap: dictionary and chrome after each event."""
    word, found = _word()
    kind = F.when(_kind() == "close", "move").otherwise(_kind())
    return longs(ev.reader(_events(spark, sf_dir), "user_id", kind, word, found).select("user_id", "event_id", "depth", "top", "chrome"), "depth")


@query(f"""WITH {EV}, r AS (SELECT event_id, '[{{"x":' || k || ',"y":' || (k * 7 % 800) || ',"width":2' || CASE WHEN k % 3 = 0 THEN '' ELSE ',"height":3' END || '}}]' AS js, k FROM ev)
SELECT event_id, CASE WHEN k % 3 = 0 THEN 0::BIGINT ELSE 1::BIGINT END AS n_rects, CASE WHEN k % 3 <> 0 THEN k + 2.0 END AS right_edge, k % 3 <> 0 AND k % 2 = 0 AS shown, k * 7 % 800 > 400 AS at_top FROM r""")
def hit_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles decoded from JSON, incomplete ones dropped; where a definition is shown."""
    k = F.col("k")
    js = F.concat(F.lit('[{"x":'), k, F.lit(',"y":'), k * 7 % 800, F.lit(',"width":2'), F.when(k % 3 == 0, "").otherwise(',"height":3'), F.lit("}]"))
    rects = F.filter(F.from_json(js, "array<struct<x:double,y:double,width:double,height:double>>"), lambda r: r["x"].isNotNull() & r["y"].isNotNull() & r["width"].isNotNull() & r["height"].isNotNull())
    x = _events(spark, sf_dir).select("event_id", "k", F.inline(F.array(F.struct(rects.alias("r")))))
    first = F.get("r", F.lit(0))
    return longs(x.select("event_id", F.size("r").alias("n_rects"), (first["x"] + first["width"]).alias("right_edge"), (first.isNotNull() & (F.col("k") % 2 == 0)).alias("shown"), (F.col("k") * 7 % 800 > 400).alias("at_top")), "n_rects")


# ---- streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of files, with the columns of _events."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return ev.timed(rows).withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long")))


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    base = fresh(spark, name)
    return f"{base}/state", f"{base}/out"


@query(_throttle_sql(HOURS * 3600))
def throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stateful.throttled(_stream(spark, sf_dir).select("user_id", "us", "event_id"), "user_id", HOURS * 3600)
    return stateful.drained(kept, *_folders(spark, "throttle"))


@query(f"SELECT user_id, event_id, depth, top FROM ({_NAV})")
def nav_stack_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    word, found = _word()
    rows = _stream(spark, sf_dir).select("user_id", "us", "event_id", _kind().alias("kind"), word.alias("word"), found.alias("found"))
    return stateful.drained(stateful.navigation(rows, "user_id"), *_folders(spark, "navigation"))


@query(f"WITH {EV}, l AS (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) SELECT user_id, event_id, event_type FROM l WHERE rn = 1 OR b IS DISTINCT FROM event_type")
def distinct_until_changed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select("user_id", "us", "event_id", "event_type")
    return stateful.drained(stateful.changed(rows, "user_id", "event_type"), *_folders(spark, "changed"))


@query(f"SELECT user_id, event_id, suppressed FROM ({_tap_sql(2 * 3600)})")
def tap_suppression_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "press").when(F.col("event_type") == "purchase", "tap")
    rows = _stream(spark, sf_dir).select("user_id", "us", "event_id", kind.alias("kind")).where("kind IS NOT NULL")
    return stateful.drained(stateful.taps(rows, "user_id", 2 * 3600), *_folders(spark, "taps"))


@query(f"""WITH k AS ({_throttle_sql(HOURS * 3600)}) SELECT user_id, max(us) AS us, arg_max(event_id, us) AS event_id FROM k GROUP BY user_id""")
def saved_locations_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throttled locations kept in a store, the last of each user, as they come."""
    kept = stateful.throttled(_stream(spark, sf_dir).select("user_id", "us", "event_id"), "user_id", HOURS * 3600)
    base = fresh(spark, "locations")
    return stores.upserted(kept, f"{base}/store", "user_id", ["us", "event_id"], f"{base}/state")
