"""Memory tables derived from the star-schema tables by SQL that Spark and DuckDB both run.

``{name}`` stands for a base table, ``LIST(`` for the array constructor.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

# name -> (bindings it reads, SQL)
BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "turns": (
        (),
        """SELECT conv_id AS session_id,
       't' || lpad(CAST(conv_id AS STRING), 8, '0') || '-' || lpad(CAST(turn AS STRING), 4, '0') AS turn_id,
       role, text AS content, CAST(turn AS INT) AS turn_index FROM {conversations}""",
    ),
    "log": (
        (),
        """SELECT conv_id AS session_id,
       't' || lpad(CAST(conv_id AS STRING), 8, '0') || '-' || lpad(CAST(turn AS STRING), 4, '0') AS turn_id,
       role, text AS content, CAST(turn AS INT) AS turn_index, turn < conv_id % 3 AS summarized FROM {conversations}""",
    ),
    "sessions": (
        (),
        """SELECT conv_id AS session_id, CAST(min(conv_id % 9) AS BIGINT) AS processed_count FROM {conversations}
GROUP BY conv_id""",
    ),
    "cuts": (
        (),
        """SELECT conv_id AS session_id, CASE WHEN conv_id % 8 = 5 THEN 'unknown' ELSE
       't' || lpad(CAST(conv_id AS STRING), 8, '0') || '-' || lpad(CAST(turn AS STRING), 4, '0') END AS turn_id
FROM {conversations} WHERE turn = conv_id % 5 + 1 OR turn = conv_id % 3 + 2""",
    ),
    "story": (
        (),
        """SELECT CAST(c_nationkey AS BIGINT) AS session_id, 's' || lpad(CAST(c_custkey AS STRING), 12, '0') AS turn_id,
       'user' AS role,
       'Cust' || CAST(c_custkey AS STRING) || ' is at ' || n_name || '. Cust' || CAST(c_custkey % 700 AS STRING)
       || ' is a ' || lower(c_mktsegment) || ' buyer. Cust' || CAST(c_custkey % 300 AS STRING)
       || CASE WHEN c_custkey % 2 = 0 THEN ' thinks ' ELSE ' believes ' END || n_name || ' is '
       || CASE WHEN c_acctbal < 0 THEN 'not ' ELSE '' END || 'strong.' AS content,
       CAST(c_custkey AS INT) AS turn_index
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT CAST(s_nationkey AS BIGINT), 'w' || lpad(CAST(p_partkey AS STRING), 12, '0'), 'assistant',
       'Supp' || CAST(s_suppkey AS STRING) || ' has ' || CASE WHEN s_suppkey % 3 = 0 THEN 'the ' ELSE 'a ' END
       || p_name || '.', CAST(1000000000 + p_partkey AS INT)
FROM (SELECT p_partkey, p_name, p_partkey % (SELECT count(*) FROM {supplier}) + (SELECT min(s_suppkey) FROM {supplier}) AS seller
FROM {part}) JOIN {supplier} ON s_suppkey = seller""",
    ),
    "opinions": (
        (),
        """SELECT 'o' || lpad(CAST(c_custkey AS STRING), 12, '0') AS id, CAST(c_custkey AS BIGINT) AS seq,
       'Cust' || CAST(c_custkey % 300 AS STRING) AS viewpoint_holder,
       n_name || ' is ' || CASE WHEN c_acctbal < 0 THEN 'not ' ELSE '' END || lower(c_mktsegment)
       || ' and strong.' AS content,
       CASE WHEN c_custkey % 100 = 7 THEN '' ELSE n_name END AS entity,
       's' || lpad(CAST(c_custkey AS STRING), 12, '0') AS source_turn_id,
       CAST(c_custkey % 10 + 1 AS DOUBLE) / 10 AS confidence, CAST(c_custkey % 3 AS BIGINT) AS relevance
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    ),
    "opinion_facts": (
        (),
        """SELECT 'f' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS id, CAST(o_orderkey AS BIGINT) AS seq,
       '  ' || n_name || ' is ' || lower(c_mktsegment) || '  and STRONG. ' AS content
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    ),
    "atomic": (
        (),
        """SELECT CAST(doc_id AS BIGINT) AS seq, 'd' || lpad(CAST(doc_id AS STRING), 12, '0') AS id, text AS content,
       CASE lang WHEN 'en' THEN 'fact' WHEN 'fr' THEN 'opinion' WHEN 'de' THEN 'rule' ELSE 'summary' END AS kind,
       CASE lang WHEN 'en' THEN 'observation' WHEN 'fr' THEN 'opinion' WHEN 'de' THEN 'world' ELSE 'experience' END
       AS network,
       CASE WHEN lang = 'fr' THEN 'narrator' END AS viewpoint_holder, lang AS entity, source AS tag,
       't' || lpad(CAST(doc_id AS STRING), 12, '0') AS source_turn_id,
       CAST(doc_id % 9 + 1 AS DOUBLE) / 10 AS confidence,
       CASE WHEN length(text) > 0 THEN text ELSE '(empty)' END AS quote
FROM {documents}""",
    ),
    "cards_in": (
        (),
        """SELECT CAST(event_id AS BIGINT) AS seq, 'c' || lpad(CAST(event_id AS STRING), 12, '0') AS id,
       'user:' || CAST(user_id AS STRING) AS entity_id, 'user' || CAST(event_id % 2 AS STRING) AS entity_type,
       'User' || CAST(user_id AS STRING) AS canonical_name, 'observation' AS network,
       'User' || CAST(user_id AS STRING) || ' seen.' AS content, 'u' || CAST(event_id % 7 AS STRING) AS alias,
       't' || lpad(CAST(event_id AS STRING), 12, '0') AS source_turn_id,
       CAST(event_id % 5 + 5 AS DOUBLE) / 10 AS confidence, event_type || CAST(event_id % 3 AS STRING) AS quote
FROM {events}""",
    ),
    "claims": (
        (),
        """SELECT CAST(event_id AS BIGINT) AS seq, 0 AS place,
       'user:' || CAST(user_id AS STRING) AS entity_id, event_type AS key,
       CAST(CAST(floor(value / 10) AS BIGINT) AS STRING) AS value_json,
       't' || lpad(CAST(event_id AS STRING), 12, '0') AS turn_start,
       't' || lpad(CAST(event_id AS STRING), 12, '0') AS source_turn_id,
       CAST(event_id % 5 + 5 AS DOUBLE) / 10 AS confidence, 'q' || CAST(event_id % 3 AS STRING) AS quote
FROM {events}
UNION ALL
SELECT CAST(event_id AS BIGINT), 1, 'user:' || CAST(user_id AS STRING), event_type,
       CAST(CAST(floor(value / 10) AS BIGINT) + 1 AS STRING), 't' || lpad(CAST(event_id AS STRING), 12, '0'),
       't' || lpad(CAST(event_id AS STRING), 12, '0'), CAST(event_id % 4 + 6 AS DOUBLE) / 10,
       'r' || CAST(event_id % 3 AS STRING)
FROM {events} WHERE event_id % 11 = 0""",
    ),
    "lore": (
        (),
        """SELECT 'v' || lpad(CAST(vec_id AS STRING), 12, '0') AS id, CAST(vec_id AS BIGINT) AS seq, embedding,
       CASE label % 4 WHEN 0 THEN 'world' WHEN 1 THEN 'experience' WHEN 2 THEN 'observation' ELSE 'opinion' END
       AS network, CASE WHEN label % 4 = 3 THEN 'holder' || CAST(label AS STRING) END AS viewpoint_holder,
       'label:' || CAST(label AS STRING) AS tag, 'lore of label ' || CAST(label AS STRING) AS content,
       't' || lpad(CAST(vec_id * 7 % 1000 AS STRING), 12, '0') AS source_turn_id
FROM {embeddings}""",
    ),
    "queries": (
        (),
        """SELECT CAST(item_id AS BIGINT) AS query_id, text AS query FROM {benchmark} WHERE text <> ''""",
    ),
    "query_vectors": (
        (),
        """SELECT query_id, embedding AS vector FROM (SELECT CAST(item_id AS BIGINT) AS query_id,
       item_id % (SELECT count(*) FROM {embeddings}) + (SELECT min(vec_id) FROM {embeddings}) AS own
FROM {benchmark} WHERE text <> '') JOIN {embeddings} ON vec_id = own""",
    ),
    "all_vectors": (
        (),
        "SELECT CAST(vec_id AS BIGINT) AS query_id, embedding AS vector FROM {embeddings}",
    ),
    "names": (
        (),
        """SELECT 'e:' || CAST(item_id AS STRING) AS entity_id, CAST(item_id * 2 AS BIGINT) AS reg_seq,
       text AS name FROM {benchmark} WHERE text <> ''
UNION ALL
SELECT 'lang:' || lang, CAST(1000000000 + min(doc_id) AS BIGINT), lang FROM {documents} WHERE lang IS NOT NULL GROUP BY lang""",
    ),
    "corpus": (
        (),
        """SELECT 'd' || lpad(CAST(doc_id AS STRING), 12, '0') AS id, 'fact' AS kind,
       CASE doc_id % 3 WHEN 0 THEN 'world' WHEN 1 THEN 'experience' ELSE 'observation' END AS network,
       CAST(NULL AS STRING) AS viewpoint_holder, text AS content, 'e:' || CAST(doc_id % 40 AS STRING) AS entity,
       't' || lpad(CAST(doc_id * 13 % 1009 AS STRING), 12, '0') AS recency_key
FROM {documents}
UNION ALL
SELECT 'v' || lpad(CAST(vec_id AS STRING), 12, '0'), 'lore',
       CASE label % 4 WHEN 0 THEN 'world' WHEN 1 THEN 'experience' WHEN 2 THEN 'observation' ELSE 'opinion' END,
       CASE WHEN label % 4 = 3 THEN 'holder' || CAST(label AS STRING) END,
       'lore of label ' || CAST(label AS STRING), CAST(NULL AS STRING),
       't' || lpad(CAST(vec_id * 7 % 1000 AS STRING), 12, '0')
FROM {embeddings}""",
    ),
    "raw_assets": (
        (),
        """SELECT CAST(doc_id AS BIGINT) AS seq,
       CASE WHEN doc_id % 53 = 0 THEN '' ELSE 'd' || lpad(CAST(doc_id AS STRING), 12, '0') END AS id,
       CASE doc_id % 4 WHEN 0 THEN 'world' WHEN 1 THEN 'experience' WHEN 2 THEN 'observation' ELSE 'opinion' END
       AS network,
       CASE doc_id % 7 WHEN 0 THEN 'fact' WHEN 1 THEN 'entity' WHEN 2 THEN 'rule' WHEN 3 THEN 'lore'
       WHEN 4 THEN 'summary' WHEN 5 THEN 'reflection' ELSE 'opinion' END AS kind,
       CASE WHEN doc_id % 41 = 0 THEN '' ELSE text END AS content,
       CASE WHEN doc_id % 37 = 0 THEN '' ELSE 't' || lpad(CAST(doc_id % 500 AS STRING), 12, '0') END AS source_turn_id,
       CAST(doc_id % 12 AS DOUBLE) / 10 AS confidence_score,
       CASE doc_id % 9 WHEN 0 THEN 'user_asserted' WHEN 1 THEN 'narrator_asserted' WHEN 2 THEN 'derived'
       WHEN 3 THEN 'external' WHEN 4 THEN 'guessed' ELSE 'inferred' END AS confidence_source,
       CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE 't' || lpad(CAST(doc_id % 500 AS STRING), 12, '0') END
       AS anchor_turn_id,
       CASE WHEN doc_id % 17 = 0 THEN '' ELSE lang || ' says' END AS quote,
       CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 50 AS INT) END AS char_start,
       CASE WHEN doc_id % 3 = 0 AND doc_id % 19 <> 0 THEN CAST(doc_id % 60 AS INT) END AS char_end,
       CASE WHEN doc_id % 43 = 0 THEN '' ELSE 't' || lpad(CAST(doc_id % 500 AS STRING), 12, '0') END AS turn_start,
       CASE WHEN doc_id % 2 = 0 THEN 't' || lpad(CAST(doc_id % 500 + 3 AS STRING), 12, '0') END AS turn_end,
       CASE WHEN doc_id % 6 = 1 THEN 'year 1' END AS narrative_start, CASE WHEN doc_id % 6 = 2 THEN 'year 2' END
       AS narrative_end, doc_id % 5 = 2 AS narrative_always,
       CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 4 = 3 OR doc_id % 10 = 0 THEN 'narrator' END AS viewpoint_holder,
       CASE WHEN doc_id % 23 = 0 THEN '' ELSE lang END AS entity, CASE WHEN doc_id % 29 = 0 THEN '' ELSE source END
       AS tag, CAST(doc_id % 8 - 1 AS BIGINT) AS relevance,
       CASE WHEN doc_id % 7 = 1 AND doc_id % 5 <> 0 THEN 'ent:' || CAST(doc_id % 90 AS STRING) END AS entity_id
FROM {documents}""",
    ),
    "graph_mentions": (
        (),
        """SELECT DISTINCT 'a' || lpad(CAST(l_orderkey AS STRING), 12, '0') AS asset_id,
       'order ' || CAST(l_orderkey AS STRING) AS content, 'p:' || CAST(l_partkey AS STRING) AS entity_id
FROM {lineitem}""",
    ),
    "cards": (
        (),
        """SELECT 'p:' || CAST(p_partkey AS STRING) AS entity_id, p_name AS label, p_type AS entity_type
FROM {part} WHERE p_size <> 13""",
    ),
    "usage": (
        (),
        """SELECT 't' || lpad(CAST(conv_id AS STRING), 8, '0') || '-' || lpad(CAST(turn AS STRING), 4, '0') AS turn_id,
       CASE conv_id % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' WHEN 2 THEN 'small' ELSE 'unpriced' END AS model,
       CAST(length(text) AS BIGINT) AS input_tokens, CAST(conv_id % 50 + turn AS BIGINT) AS output_tokens,
       CASE WHEN turn % 2 = 0 THEN CAST(100 + turn AS BIGINT) END AS cache_write_tokens,
       CASE WHEN turn % 3 = 0 THEN CAST(1000 + conv_id AS BIGINT) END AS cache_read_tokens
FROM {conversations}""",
    ),
    "prices": (
        (),
        """SELECT CASE r_regionkey WHEN 0 THEN 'large' WHEN 1 THEN 'medium' ELSE 'small' END AS model,
       CAST(CASE r_regionkey WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END AS DOUBLE) AS input_price,
       CAST(CASE r_regionkey WHEN 0 THEN 25 WHEN 1 THEN 15 ELSE 5 END AS DOUBLE) AS output_price
FROM {region} WHERE r_regionkey < 3""",
    ),
    "anchored": (
        (),
        """SELECT CAST(doc_id AS BIGINT) AS doc_id, text AS content,
       CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN lang || '#' || source
       ELSE substring(text, CAST(doc_id % 300 AS INT) + 1, 25) END AS quote FROM {documents}""",
    ),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in (*_closure(BINDINGS[name][0]), name):
            if need not in out:
                out.append(need)
    return out


#: Large text tables, which are spread if they come in few partitions.
TEXT_TABLES = ("documents", "conversations", "pages")


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A base table. A text table in fewer partitions than there are cores is spread over them.

    With files enough to go round, as on a cluster, it is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if table in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def _spark_sql(spark: SparkSession, sql: str, sf_dir: str) -> str:
    def view(match: re.Match) -> str:
        table = match.group(1)
        name = f"{table}_{zlib.crc32(sf_dir.encode())}"
        base(spark, sf_dir, table).createOrReplaceTempView(name)
        return name

    return re.sub(r"\{(\w+)\}", view, sql).replace("LIST(", "array(")


def _duck_sql(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("LIST(", "list_value(")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A memory table as a DataFrame over the files of ``sf_dir``."""
    parts = [f"{n} AS ({_spark_sql(spark, BINDINGS[n][1], sf_dir)})" for n in _closure((name,))]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def ctes(*names: str) -> str:
    """The same tables as a DuckDB ``WITH`` list (without the keyword)."""
    return reduce(lambda s, n: s + f"{n} AS ({_duck_sql(BINDINGS[n][1])}), ", _closure(names), "")


def with_tables(names: str, sql: str, recursive: bool = False) -> str:
    """``sql`` preceded by the named memory tables; it may go on with further CTEs, comma first."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = ctes(*names.split()).rstrip(", ")
    joint = "" if sql.lstrip().startswith(",") or not sql.lstrip().upper().startswith("SELECT") else " "
    return head + body + joint + "\n" + sql
