"""Registry of queries; a query may come with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, using: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query. ``using`` names shared table expressions put in front of ``sql``."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_tables(using, sql)
        return build

    return register


def with_tables(using: tuple[str, ...], sql: str) -> str:
    wanted: list[str] = []

    def need(table: str) -> None:
        if table in wanted:
            return
        for parent in TABLES[table][0]:
            need(parent)
        wanted.append(table)

    for table in using:
        need(table)
    if not wanted:
        return sql.strip()
    heads = ",\n".join(f"{t} AS ({TABLES[t][1].strip()})" for t in wanted)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads},\n{sql[len('WITH RECURSIVE '):]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {heads},\n{sql[len('WITH '):]}"
    return f"WITH {heads}\n{sql}"


# Shared table expressions of the oracle SQL: name -> (tables it reads, SELECT).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "utterances": ((), """
        SELECT conv_id AS recording_id, turn AS segment_idx, role AS speaker, text,
          CAST(sum(60 * length(text)) OVER w - 60 * length(text) AS BIGINT) AS start_ms,
          CAST(sum(60 * length(text)) OVER w AS BIGINT) AS end_ms
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""),
    "word_lists": (("utterances",), """
        SELECT *, string_split(text, ' ') AS ws FROM utterances"""),
    "word_rows": (("word_lists",), """
        SELECT recording_id, segment_idx, start_ms AS t0, unnest(ws) AS word,
          CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos FROM word_lists"""),
    "words": (("word_rows",), """
        SELECT recording_id, segment_idx, pos, word,
          CAST(t0 + 60 * (sum(length(word) + 1) OVER w - length(word) - 1) AS BIGINT) AS start_ms,
          CAST(t0 + 60 * (sum(length(word) + 1) OVER w - 1) AS BIGINT) AS end_ms
        FROM word_rows WINDOW w AS (PARTITION BY recording_id, segment_idx ORDER BY pos)"""),
    "null_words": (("words",), """
        SELECT recording_id, segment_idx, pos, word,
          CASE WHEN regexp_full_match(word, '[a-zA-Z]+') THEN start_ms END AS start_ms,
          CASE WHEN regexp_full_match(word, '[a-z][a-zA-Z]*') THEN end_ms END AS end_ms
        FROM words"""),
    "speaker_turns": (("utterances",), """
        SELECT recording_id, segment_idx AS turn_idx, 'T' || segment_idx AS track, speaker,
          CASE WHEN segment_idx % 2 = 0 THEN greatest(start_ms - 3000, 0)
               ELSE start_ms + (end_ms - start_ms) // 4 END AS start_ms,
          CASE WHEN segment_idx % 2 = 0 THEN end_ms + 1500 ELSE end_ms - (end_ms - start_ms) // 4 END AS end_ms
        FROM utterances"""),
    "score_frames": ((), """
        SELECT user_id AS recording_id,
          CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'front' ELSE 'back' END AS class,
          epoch_us(ts) AS t_us, event_id, value AS score FROM events"""),
    "signal": ((), """
        SELECT user_id AS recording_id,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS sample_idx, value
        FROM events"""),
    "raw_regions": (("score_frames",), """
        WITH fixed AS (
          SELECT *, CASE WHEN score > 60 THEN 1 WHEN score < 30 THEN 0 END AS fix FROM score_frames),
        held AS (
          SELECT *, coalesce(last_value(fix IGNORE NULLS) OVER (PARTITION BY recording_id, class
              ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st,
            row_number() OVER (PARTITION BY recording_id, class ORDER BY t_us DESC, event_id DESC) = 1 AS final
          FROM fixed),
        stepped AS (
          SELECT *, coalesce(lag(st) OVER (PARTITION BY recording_id, class ORDER BY t_us, event_id), 0) AS was
          FROM held),
        numbered AS (
          SELECT *, sum(CASE WHEN st = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, class
            ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM stepped),
        spans AS (
          SELECT recording_id, class, min(t_us) FILTER (st = 1) AS start_us,
            max(t_us) FILTER ((st = 0 AND was = 1) OR (st = 1 AND final)) AS end_us
          FROM numbered WHERE r > 0 GROUP BY recording_id, class, r)
        SELECT recording_id, class, start_us, end_us FROM spans"""),
    "regions": (("raw_regions",), """
        SELECT recording_id, class, CAST(row_number() OVER (PARTITION BY recording_id, class
            ORDER BY start_us, end_us) - 1 AS BIGINT) AS region_idx, start_us, end_us
        FROM raw_regions WHERE end_us > start_us"""),
    "all_regions": (("regions",), """
        SELECT recording_id, start_us, end_us, row_number() OVER (PARTITION BY recording_id ORDER BY start_us, end_us) AS rn
        FROM (SELECT DISTINCT recording_id, start_us, end_us FROM regions)"""),
    "turn_pairs": (("utterances", "speaker_turns"), """
        SELECT u.recording_id, u.segment_idx, t.turn_idx, t.speaker, t.start_ms AS turn_start_ms,
          least(u.end_ms, t.end_ms) - greatest(u.start_ms, t.start_ms) AS overlap_ms
        FROM utterances u JOIN speaker_turns t ON u.recording_id = t.recording_id
          AND t.start_ms < u.end_ms AND t.end_ms > u.start_ms
          AND least(u.end_ms, t.end_ms) > greatest(u.start_ms, t.start_ms)"""),
    "placed_words": (("null_words",), """
        SELECT recording_id, segment_idx, pos, word, start_ms, coalesce(end_ms, start_ms) AS end_ms
        FROM null_words WHERE start_ms IS NOT NULL"""),
    "word_speakers": (("placed_words", "speaker_turns"), """
        WITH pairs AS (
          SELECT w.recording_id, w.segment_idx, w.pos, t.speaker, t.turn_idx, t.start_ms AS ts,
            least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms) AS o
          FROM placed_words w JOIN speaker_turns t ON w.recording_id = t.recording_id
            AND t.start_ms < w.end_ms AND t.end_ms > w.start_ms
          WHERE least(w.end_ms, t.end_ms) > greatest(w.start_ms, t.start_ms)),
        sums AS (
          SELECT recording_id, segment_idx, pos, speaker, sum(o) AS total, min((ts, turn_idx)) AS f
          FROM pairs GROUP BY ALL)
        SELECT recording_id, segment_idx, pos, speaker, CAST(total AS BIGINT) AS overlap_ms FROM sums
        QUALIFY row_number() OVER (PARTITION BY recording_id, segment_idx, pos ORDER BY total DESC, f) = 1"""),
    "segment_speakers": (("turn_pairs",), """
        WITH sums AS (
          SELECT recording_id, segment_idx, speaker, sum(overlap_ms) AS total, min((turn_start_ms, turn_idx)) AS f
          FROM turn_pairs GROUP BY ALL)
        SELECT recording_id, segment_idx, speaker, CAST(total AS BIGINT) AS overlap_ms FROM sums
        QUALIFY row_number() OVER (PARTITION BY recording_id, segment_idx ORDER BY total DESC, f) = 1"""),
    "far_words": (("placed_words", "word_speakers"), """
        SELECT w.* FROM placed_words w ANTI JOIN word_speakers s USING (recording_id, segment_idx, pos)"""),
    "nearest": (("far_words", "speaker_turns"), """
        SELECT w.recording_id, w.segment_idx, w.pos, t.speaker
        FROM far_words w JOIN speaker_turns t USING (recording_id)
        QUALIFY row_number() OVER (PARTITION BY w.recording_id, w.segment_idx, w.pos
          ORDER BY abs((t.start_ms + t.end_ms) - (w.start_ms + w.end_ms)), t.start_ms, t.turn_idx) = 1"""),
}
