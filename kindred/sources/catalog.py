"""The catalogue's shapes over the driver's tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # One row a file: path, folder, kind, size, duration in seconds, flags and stream facts.
    "files": """SELECT doc_id AS file_id, concat('/lib/', source, '/d', CAST(doc_id % 7 AS STRING), '/f', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.mkv' WHEN 3 THEN '.mp3' ELSE '.txt' END) AS path,
      concat('/lib/', source, '/d', CAST(doc_id % 7 AS STRING)) AS folder, doc_id % 5 = 0 AS is_image, n_chars AS size_bytes, n_chars AS duration, 1600000000 + (doc_id * 7919) % 1000000 AS mtime, CAST(doc_id % 16 AS INT) AS flags, lang AS codec,
      CAST(320 + (doc_id % 13) * 160 AS INT) AS width, CAST(240 + (doc_id % 7) * 120 AS INT) AS height, CAST(24 + (doc_id % 3) * 6 AS INT) AS fps, n_chars * 8 AS bit_rate, CAST(doc_id % 3 AS INT) AS channels, doc_id % 40 AS ino, doc_id % 2 AS dev FROM {documents}""",
    # Duplicate edges: similarity in thousandths, method, offset.
    "pairs": """SELECT a.doc_id AS file_a, b.doc_id AS file_b, CAST(floor(1000.0 * least(a.n_chars, b.n_chars) / greatest(a.n_chars, b.n_chars)) AS BIGINT) AS sim, CASE (a.doc_id + b.doc_id) / 20 % 3 WHEN 0 THEN 'FrameSimilarity' WHEN 1 THEN 'AudioMatch' ELSE 'TimelineMatch' END AS method, (a.doc_id * 3) % 50 AS clip_offset
      FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id + 20 WHERE a.n_chars > 0 AND b.n_chars > 0""",
    # Group members: parts of a brand.
    "members": """SELECT p_brand AS group_id, p_partkey AS item_id, concat('/lib/', p_type, '/', p_name, CAST(p_partkey AS STRING)) AS path, CAST(p_size AS BIGINT) AS size_bytes, CAST(p_partkey % 90 AS BIGINT) AS duration, CAST(p_partkey % 8 AS INT) * 480 AS frame_size, CAST(p_partkey % 5 AS INT) * 12 AS fps, CAST(floor(p_retailprice) AS BIGINT) AS bitrate,
      CAST(p_partkey % 3 AS INT) * 22050 AS audio_rate, 900 + p_partkey % 101 AS sim, 1600000000 + (p_partkey * 7919) % 1000000 AS created, CAST(p_partkey % 16 AS INT) AS flags, p_partkey % 11 = 0 AS is_image, p_partkey % 4 = 0 AS checked FROM {part}""",
    # Points of a time series: one an event.
    "points": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 65535 WHEN 'signup' THEN 16711935 WHEN 'error' THEN 4042322160 ELSE 252645135 END AS BIGINT) AS block FROM {events}",
    "blacklist": "SELECT doc_id % 50 AS entry_id, concat('/lib/', source, '/d', CAST(doc_id % 7 AS STRING)) AS path FROM {documents} WHERE doc_id % 3 = 0",
}
_TABLES = ("documents", "part", "events", "labels", "lineitem", "orders", "pages", "customer", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalogue view over the tables in sf_dir."""
    sql = VIEWS[name]
    return spark.sql(sql.replace("/ 20 % 3", "DIV 20 % 3"), **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names in front."""
    used = [v for v in VIEWS if v in sql]
    defs = ", ".join(f"{v} AS ({_duck(VIEWS[v])})" for v in used)
    return f"WITH RECURSIVE {defs}, {sql[5:]}" if defs and sql.startswith("WITH ") else f"WITH {defs} {sql}" if defs else sql


def _duck(sql: str) -> str:
    for t in _TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("/ 20 % 3", "// 20 % 3")
