"""Turn logs, rolling summaries and the cost of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions.text import tokenize
from mnemospark.operators import cost
from mnemospark.operators import transcript as tr

from .bindings import bind, with_tables
from .registry import query
from .scalars import WS, est_sql

THRESHOLD, WINDOW = 250, 2

PLACED = """, placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS place,
 count(*) OVER (PARTITION BY session_id) AS size FROM log)"""


@query(
    "W2_rolling_summary_windows",
    with_tables(
        "log",
        f""", live AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1 AS i, {est_sql('content')} AS tok FROM log WHERE NOT summarized),
step AS (SELECT session_id, CAST(0 AS BIGINT) AS block, (SELECT sum(tok) FROM live l WHERE l.session_id = s.session_id) AS left_ FROM (SELECT DISTINCT session_id FROM live) s
 UNION ALL SELECT t.session_id, t.block + 1, t.left_ - (SELECT sum(tok) FROM live l WHERE l.session_id = t.session_id AND l.i >= t.block * {WINDOW} AND l.i < (t.block + 1) * {WINDOW})
 FROM step t WHERE t.left_ >= {THRESHOLD})
SELECT l.session_id, l.turn_id, t.block FROM step t JOIN live l ON l.session_id = t.session_id AND l.i // {WINDOW} = t.block WHERE t.left_ >= {THRESHOLD}""",
        recursive=True,
    ),
)
def w2(spark, sf):
    return tr.rolling_summary_windows(bind(spark, sf, "log"), THRESHOLD, WINDOW).select("session_id", "turn_id", "block")


@query(
    "W3_summary_flush",
    with_tables("log", " SELECT session_id, turn_id FROM log WHERE NOT summarized QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_index) <= 3"),
)
def w3(spark, sf):
    return tr.summary_flush(bind(spark, sf, "log"), 3).select("session_id", "turn_id")


@query(
    "W4_pending_turns",
    with_tables(
        "log sessions cuts",
        PLACED + """ SELECT 'pending' AS part, p.session_id, turn_id AS value FROM placed p LEFT JOIN sessions s ON s.session_id = p.session_id AND s.session_id % 6 <> 1
WHERE place > coalesce(processed_count, 0)
UNION ALL SELECT 'mark', z.session_id, CAST(greatest(least(coalesce(s.processed_count, 0), z.size), coalesce(m.place, 0)) AS VARCHAR) FROM (SELECT DISTINCT session_id, size FROM placed) z
LEFT JOIN sessions s ON s.session_id = z.session_id AND s.session_id % 6 <> 1
LEFT JOIN (SELECT session_id, max(place) AS place FROM placed JOIN cuts USING (session_id, turn_id) GROUP BY 1) m ON m.session_id = z.session_id""",
    ),
)
def w4(spark, sf):
    log, marks = bind(spark, sf, "log"), bind(spark, sf, "sessions").filter("session_id % 6 <> 1")
    pending = tr.pending_turns(log, marks).select(F.lit("pending").alias("part"), "session_id", F.col("turn_id").alias("value"))
    marked = tr.mark_processed(log, marks, bind(spark, sf, "cuts"))
    return pending.unionAll(marked.select(F.lit("mark"), "session_id", F.col("processed_count").cast("string")))


@query("W5_live_turns", with_tables("log", " SELECT turn_id FROM log WHERE NOT summarized"))
def w5(spark, sf):
    return tr.live_turns(bind(spark, sf, "log")).select("turn_id")


CUT = ", cut AS (SELECT session_id, min(turn_index) AS at_ FROM log JOIN cuts USING (session_id, turn_id) GROUP BY 1)"


@query(
    "W6_context_before",
    with_tables("log cuts", CUT + " SELECT turn_id FROM log JOIN cut USING (session_id) WHERE turn_index < at_ AND NOT summarized"),
)
def w6(spark, sf):
    return tr.context_before(bind(spark, sf, "log"), bind(spark, sf, "cuts")).select("turn_id")


@query(
    "W7_truncate_from",
    with_tables(
        "log cuts sessions",
        CUT + """, k AS (SELECT l.*, coalesce(turn_index < at_, true) AS kept FROM log l LEFT JOIN cut USING (session_id))
SELECT CASE WHEN kept THEN 'kept' ELSE 'removed' END AS part, turn_id AS value FROM k
UNION ALL SELECT 'mark', session_id || ':' || least(processed_count, coalesce(n, 0)) FROM sessions LEFT JOIN (SELECT session_id, count(*) AS n FROM k WHERE kept GROUP BY 1) USING (session_id)""",
    ),
)
def w7(spark, sf):
    kept, removed = tr.truncate_from(bind(spark, sf, "log"), bind(spark, sf, "cuts"))
    marks = tr.clamp_marks(bind(spark, sf, "sessions"), kept)
    return (
        kept.select(F.lit("kept").alias("part"), F.col("turn_id").alias("value"))
        .unionAll(removed.select(F.lit("removed"), "turn_id"))
        .unionAll(marks.select(F.lit("mark"), F.concat_ws(":", "session_id", "processed_count")))
    )


@query(
    "W8_replace_from",
    with_tables(
        "log cuts",
        CUT + """ SELECT turn_id, content, summarized FROM log LEFT JOIN cut USING (session_id) WHERE coalesce(turn_index < at_, true)
UNION ALL SELECT 'new-' || turn_id || '-' || session_id, 'again', false FROM cuts""",
    ),
)
def w8(spark, sf):
    cuts = bind(spark, sf, "cuts")
    new = cuts.select(
        "session_id", F.concat(F.lit("new-"), "turn_id", F.lit("-"), "session_id").alias("turn_id"), F.lit("user").alias("role"),
        F.lit("again").alias("content"), F.lit(99).alias("turn_index"),
    )
    return tr.replace_from(bind(spark, sf, "log"), cuts, new).select("turn_id", "content", "summarized")


@query(
    "W9_clear_turns",
    with_tables(
        "log sessions",
        """ SELECT 'turn' AS part, turn_id AS value FROM log WHERE session_id % 4 <> 2
UNION ALL SELECT 'session', session_id || ':' || CASE WHEN session_id % 4 = 2 THEN 0 ELSE processed_count END FROM sessions""",
    ),
)
def w9(spark, sf):
    sessions = bind(spark, sf, "sessions")
    turns, marks = tr.clear_turns(bind(spark, sf, "log"), sessions, sessions.filter("session_id % 4 = 2"))
    return turns.select(F.lit("turn").alias("part"), F.col("turn_id").alias("value")).unionAll(
        marks.select(F.lit("session"), F.concat_ws(":", "session_id", "processed_count"))
    )


@query(
    "W10_duplicate_turns",
    with_tables(
        "turns",
        """, c AS (SELECT session_id || '-' || (turn_index // 2) AS turn_id, session_id * 10000 + turn_index AS seq, content FROM turns)
SELECT turn_id, seq, row_number() OVER (PARTITION BY turn_id ORDER BY seq) > 1 AS rejected FROM c""",
    ),
)
def w10(spark, sf):
    t = bind(spark, sf, "turns")
    copies = t.select(
        F.concat("session_id", F.lit("-"), F.floor(F.col("turn_index") / 2)).alias("turn_id"),
        (F.col("session_id") * 10000 + F.col("turn_index")).alias("seq"),
    )
    kept, rejected = tr.duplicate_turns(copies)
    return kept.select("turn_id", "seq", F.lit(False).alias("rejected")).unionAll(rejected.select("turn_id", "seq", F.lit(True)))


@query(
    "W11_progress_sync",
    with_tables(
        "log sessions cuts",
        """ SELECT 'session' AS part, session_id || ':' || CASE WHEN session_id % 3 = 0 THEN processed_count + 2 ELSE processed_count END AS value FROM sessions
UNION ALL SELECT 'turn', l.turn_id || ':' || (l.summarized OR c.turn_id IS NOT NULL) FROM log l LEFT JOIN (SELECT DISTINCT * FROM cuts) c USING (session_id, turn_id)""",
    ),
)
def w11(spark, sf):
    sessions = bind(spark, sf, "sessions")
    progress = sessions.filter("session_id % 3 = 0").withColumn("processed_count", F.col("processed_count") + 2)
    cuts = bind(spark, sf, "cuts")
    once = tr.progress_sync(sessions, bind(spark, sf, "log"), progress, cuts)
    told, marked = tr.progress_sync(*once, progress, cuts)
    return told.select(F.lit("session").alias("part"), F.concat_ws(":", "session_id", "processed_count").alias("value")).unionAll(
        marked.select(F.lit("turn"), F.concat_ws(":", "turn_id", F.col("summarized").cast("string")))
    )


@query(
    "A8_live_tokens",
    with_tables("log", f""" SELECT session_id, CAST(sum(CASE WHEN summarized THEN 0 ELSE {est_sql('content')} END) AS BIGINT) AS live_tokens, count(*) AS turns,
 count(*) FILTER (WHERE summarized) AS summarized FROM log GROUP BY 1"""),
)
def a8(spark, sf):
    return tr.live_tokens(bind(spark, sf, "log"))


BLOCKS = f""", live AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1) // {WINDOW} AS block,
 sum({est_sql('content')}) OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS suffix,
 regexp_extract(regexp_replace(content, '^{WS}+|{WS}+$', '', 'g'), '^[a-zA-Z0-9_'']+', 0) AS w FROM log WHERE NOT summarized),
blk AS (SELECT session_id, CAST(block AS BIGINT) AS block, min(turn_id) AS first_, max(turn_id) AS last_, count(*) AS n, max(suffix) AS suffix,
 '[' || min(turn_id) || '..' || max(turn_id) || '] ' || count(*) || CASE WHEN count(*) = 1 THEN ' turn: ' ELSE ' turns: ' END
 || coalesce(string_agg(w, ', ' ORDER BY turn_index) FILTER (WHERE w <> ''), '') AS stub,
 string_agg(turn_id || '=' || substring(content, 1, 64), '|' ORDER BY turn_index) FILTER (WHERE content <> '') AS anchors,
 string_agg(content, ' ' ORDER BY turn_index) AS joined,
 flatten(list(regexp_extract_all(content, '\\b[A-Z][a-zA-Z''-]*\\b') ORDER BY turn_index)) AS names FROM live GROUP BY 1, 2 HAVING max(suffix) >= {THRESHOLD})"""


@query(
    "X7_summary_assets",
    with_tables("log", BLOCKS + """ SELECT md5('summary|' || session_id || '|' || first_ || '|' || last_) AS id, stub AS content, last_ AS source_turn_id, first_ AS turn_start,
 last_ AS turn_end, anchors, CAST(0.95 AS DOUBLE) AS confidence, 'rolling-summary' AS tag FROM blk"""),
)
def x7(spark, sf):
    a = tr.summary_assets(tr.rolling_summary_windows(bind(spark, sf, "log"), THRESHOLD, WINDOW))
    p = F.col("provenance")
    anchors = F.transform(p["raw_quote_anchors"], lambda x: F.concat(x["turn_id"], F.lit("="), x["quote"]))
    return a.select(
        "id", "content", p["source_turn_id"].alias("source_turn_id"), p["temporal_range"]["turn_start"].alias("turn_start"),
        p["temporal_range"]["turn_end"].alias("turn_end"), F.array_join(anchors, "|").alias("anchors"),
        p["confidence_score"].alias("confidence"), F.col("tags")[0].alias("tag"),
    )


@query(
    "X8_summary_validate",
    with_tables("log", BLOCKS + f""", c AS (SELECT *, CASE (session_id + block) % 5 WHEN 0 THEN '  ' WHEN 1 THEN joined || joined || joined WHEN 2 THEN ' ' || coalesce(names[1], 'no') || ' moved on. '
 WHEN 3 THEN 'nobody named' END AS text FROM blk), t AS (SELECT *, regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g') AS body FROM c)
SELECT session_id, block, CASE WHEN body <> '' AND len(list_filter(regexp_split_to_array(body, '{WS}+'), lambda x: x <> '')) <= 120
 AND (len(names) = 0 OR len(list_filter(names, lambda x: contains(body, x))) > 0) THEN body ELSE stub END AS content FROM t"""),
)
def x8(spark, sf):
    from mnemospark.functions.text import capitalized_tokens

    windows = tr.rolling_summary_windows(bind(spark, sf, "log"), THRESHOLD, WINDOW)
    texts = windows.groupBy("session_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn_index", "content"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda t: t["content"]), " ")
    names = F.flatten(F.transform("t", lambda t: capitalized_tokens(t["content"])))
    m = (F.col("session_id") + F.col("block")) % 5
    text = (
        F.when(m == 0, "  ").when(m == 1, F.concat(joined, joined, joined))
        .when(m == 2, F.concat(F.lit(" "), F.coalesce(F.get(names, F.lit(0)), F.lit("no")), F.lit(" moved on. ")))
        .when(m == 3, "nobody named")
    )
    candidates = texts.select("session_id", "block", text.alias("text"))
    return tr.summary_assets(windows, candidates=candidates).select("session_id", "block", "content")


COST = """ CAST(coalesce((input_tokens * input_price + output_tokens * output_price + coalesce(cache_write_tokens, 0) * input_price * 1.25
 + coalesce(cache_read_tokens, 0) * input_price * 0.1) / 1000000, 0) AS DOUBLE)"""

#: The same in millionths of a dollar and exact, and a sum of it in dollars.
COST_UNITS = """ (CAST(coalesce(input_tokens, 0) AS DECIMAL(12,0)) * CAST(coalesce(input_price, 0) AS DECIMAL(12,6)) * CAST(1 AS DECIMAL(3,2))
 + CAST(coalesce(output_tokens, 0) AS DECIMAL(12,0)) * CAST(coalesce(output_price, 0) AS DECIMAL(12,6)) * CAST(1 AS DECIMAL(3,2))
 + CAST(coalesce(cache_write_tokens, 0) AS DECIMAL(12,0)) * CAST(coalesce(input_price, 0) AS DECIMAL(12,6)) * CAST(1.25 AS DECIMAL(3,2))
 + CAST(coalesce(cache_read_tokens, 0) AS DECIMAL(12,0)) * CAST(coalesce(input_price, 0) AS DECIMAL(12,6)) * CAST(0.1 AS DECIMAL(3,2)))"""
COST_SUM = f" (CAST(sum({COST_UNITS}) AS DECIMAL(24,8)) * CAST(0.000001 AS DECIMAL(7,6)))"


@query(
    "J9_usage_pricing_join",
    with_tables("usage prices", f" SELECT turn_id, model, round({COST}, 9) AS cost_usd FROM usage LEFT JOIN prices USING (model)"),
)
def j9(spark, sf):
    priced = cost.usage_pricing_join(bind(spark, sf, "usage"), bind(spark, sf, "prices"))
    return priced.select("turn_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "A9_cost_totals",
    with_tables("usage prices", f" SELECT model, count(*) AS calls, CAST(round({COST_SUM}, 6) AS DOUBLE) AS cost_usd FROM usage LEFT JOIN prices USING (model) GROUP BY ROLLUP (model)"),
)
def a9(spark, sf):
    priced = cost.usage_pricing_join(bind(spark, sf, "usage"), bind(spark, sf, "prices"))
    return cost.cost_totals(priced, 6)


@query(
    "A10_cost_cap_flag",
    with_tables("usage prices", f" SELECT turn_id, CAST({COST_SUM} AS DOUBLE) AS cost_usd FROM usage LEFT JOIN prices USING (model) GROUP BY 1 HAVING {COST_SUM} > 0.002"),
)
def a10(spark, sf):
    priced = cost.usage_pricing_join(bind(spark, sf, "usage"), bind(spark, sf, "prices"))
    return cost.over_cap(priced, 0.002)


@query(
    "E3_summarizer",
    with_tables("log", BLOCKS.replace("HAVING", "HAVING count(*) > 0 AND") + " SELECT session_id, block, n || ' turns until ' || last_ AS content FROM blk"),
)
def e3(spark, sf):
    own = lambda turns: F.concat(F.size(turns), F.lit(" turns until "), F.element_at(turns, -1)["turn_id"])
    windows = tr.rolling_summary_windows(bind(spark, sf, "log"), THRESHOLD, WINDOW)
    return tr.summary_assets(windows, own).select("session_id", "block", "content")


@query(
    "E5_token_estimator",
    with_tables("log", """ SELECT session_id, CAST(sum(CASE WHEN summarized THEN 0 ELSE len(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9'']+'), lambda t: t <> '')) END) AS BIGINT) AS live_tokens,
 count(*) AS turns, count(*) FILTER (WHERE summarized) AS summarized FROM log GROUP BY 1"""),
)
def e5(spark, sf):
    return tr.live_tokens(bind(spark, sf, "log"), lambda c: F.size(tokenize(c)).cast("bigint"))
