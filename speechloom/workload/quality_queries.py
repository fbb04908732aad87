"""Token clean-up, languages, batches and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.functions.fixed_values import (
    CONJUNCTIONS, LANGUAGE_ALIASES, LANGUAGE_NAMES, PRIMARY_ALIGN_MODELS, SECONDARY_ALIGN_MODELS,
)
from speechloom.functions.text import compression_ratio as ratio
from speechloom.operators import language as lg, progress as pg, quality as ql
from speechloom.sources import corpus
from speechloom.workload.registry import TABLES, query

EOT = corpus.EOT


def values_sql(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in table.items()) + ")"


TABLES.update({
    "document_words": ((), """
        SELECT doc_id, unnest(string_split(text, ' ')) AS word,
          unnest(range(len(string_split(text, ' ')))) AS pos, n_chars FROM documents"""),
    "document_tokens": (("document_words",), """
        SELECT *, CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) AS token_id FROM document_words"""),
    "vocabulary": (("document_tokens",), f"""
        SELECT token_id, min(' ' || word) AS token FROM document_tokens GROUP BY token_id
        UNION ALL SELECT * FROM (VALUES {", ".join(f"({k}, '{v}')" for k, v in corpus.SPECIAL.items())}) s(token_id, token)"""),
    "lang_scores": ((), """
        SELECT doc_id AS recording_id, '<|' || l || '|>' AS lang_token,
          CASE WHEN l = lang THEN 0.7 ELSE (1 + (doc_id + length(l) + k) % 5) / 20.0 END::DOUBLE AS prob
        FROM documents, (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3)) v(l, k)"""),
    "lang_requests": ((), """
        SELECT doc_id AS recording_id, CASE doc_id % 6 WHEN 0 THEN upper(lang)
            WHEN 1 THEN CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Castilian' END
            WHEN 2 THEN 'Flemish' WHEN 3 THEN 'klingon' WHEN 4 THEN NULL ELSE 'yue' END AS requested,
          CASE WHEN doc_id % 5 = 0 THEN 'small.en' ELSE 'large' END AS model FROM documents"""),
    "normalised": (("lang_requests",), f"""
        WITH c AS (SELECT * FROM {values_sql(LANGUAGE_NAMES)} t(code, name)),
        a AS (SELECT * FROM {values_sql(LANGUAGE_ALIASES)} t(alias, code))
        SELECT r.*, coalesce(c.code, n.code, a.code) AS language,
          requested IS NOT NULL AND coalesce(c.code, n.code, a.code) IS NULL AS unsupported
        FROM lang_requests r LEFT JOIN c ON c.code = lower(requested) LEFT JOIN c n ON n.name = lower(requested)
          LEFT JOIN a ON a.alias = lower(requested)"""),
    "progress_events": ((), """
        SELECT user_id AS recording_id, CASE event_type WHEN 'view' THEN 'segmentation' WHEN 'click' THEN 'embeddings'
            ELSE event_type END AS step, epoch_us(ts) AS t_us, event_id,
          row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS completed,
          count(*) OVER (PARTITION BY user_id, event_type) AS total FROM events"""),
})


@query("avg_logprob", """
    SELECT doc_id AS recording_id, CAST(round_even(-(n_chars % 300) / 100.0 * pow(len(string_split(text, ' ')) + 3, 1.0)
      / (len(string_split(text, ' ')) + 4) * 1000000, 0) AS BIGINT) AS micro FROM documents""")
def avg_logprob(spark, sf_dir):
    rows = corpus.token_rows(spark, sf_dir)
    value = ql.avg_logprob(F.col("score"), F.col("tokens"))
    return rows.select("recording_id", F.rint(value * 1000000).cast("bigint").alias("micro"))


@query("strip_special", f"""
    SELECT doc_id AS recording_id, count(*) FILTER (token_id < {EOT}) AS n_kept,
      coalesce(bit_xor(token_id) FILTER (token_id < {EOT}), 0) AS folded FROM document_tokens GROUP BY doc_id""",
    using=("document_tokens",))
def strip_special(spark, sf_dir):
    kept = ql.strip_special(F.col("tokens"), EOT)
    return corpus.token_rows(spark, sf_dir).select(
        "recording_id", F.size(kept).cast("bigint").alias("n_kept"),
        F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, t: a.bitwiseXOR(t)).alias("folded"))


@query("numeral_tokens", f"""
    SELECT token_id, token FROM vocabulary WHERE token_id < {EOT} AND regexp_matches(regexp_replace(token, '^ ', ''), '[0-9%$£]')""",
    using=("vocabulary",))
def numeral_tokens(spark, sf_dir):
    return ql.numeral_tokens(corpus.vocabulary(spark, sf_dir), EOT)


@query("suppress_union", f"""
    SELECT token_id FROM vocabulary WHERE token_id < {EOT} AND regexp_matches(regexp_replace(token, '^ ', ''), '[0-9%$£]')
    UNION SELECT token_id FROM vocabulary WHERE token LIKE '%(%'""", using=("vocabulary",))
def suppress_union(spark, sf_dir):
    vocabulary = corpus.vocabulary(spark, sf_dir)
    return ql.suppressed_tokens(ql.numeral_tokens(vocabulary, EOT), vocabulary.filter(F.col("token").contains("(")))


@query("detokenize", f"""
    SELECT d.doc_id AS recording_id, CAST(0 AS BIGINT) AS chunk_idx, coalesce(string_agg(' ' || t.word, '' ORDER BY t.pos), '') AS text
    FROM documents d LEFT JOIN document_tokens t ON t.doc_id = d.doc_id AND t.token_id < {EOT} GROUP BY d.doc_id""",
    using=("document_tokens",))
def detokenize(spark, sf_dir):
    return ql.detokenize(corpus.token_rows(spark, sf_dir), corpus.vocabulary(spark, sf_dir), EOT)


@query("compression_ratio")
def compression_ratio(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", ratio(F.col("text")).alias("ratio"))


@query("quality_gate", """
    SELECT doc_id AS recording_id, (n_chars % 50) / 10.0::DOUBLE > 2.4 OR -(n_chars % 300) / 200.0::DOUBLE < -1.0 AS failed,
      (n_chars % 100) / 100.0::DOUBLE > 0.6 AND -(n_chars % 300) / 200.0::DOUBLE < -1.0 AS silence FROM documents""")
def quality_gate(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("recording_id"), "text", ((F.col("n_chars") % 50) / 10.0).alias("compression_ratio"),
        (-(F.col("n_chars") % 300) / 200.0).alias("avg_logprob"), ((F.col("n_chars") % 100) / 100.0).alias("no_speech_prob"))
    return ql.quality_gate(docs).select("recording_id", "failed", "silence")


@query("detect_language", """
    SELECT recording_id, substr(lang_token, 3, length(lang_token) - 4) AS language, prob FROM lang_scores
    QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY prob DESC, lang_token) = 1""", using=("lang_scores",))
def detect_language(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    codes = F.array(*[F.lit(c) for c in ("en", "fr", "de", "es")])
    rows = docs.select(F.col("doc_id").alias("recording_id"), "lang", F.posexplode(codes).alias("k", "l"))
    other = (1 + (F.col("recording_id") + F.length("l") + F.col("k")) % 5) / 20.0
    return ql.detect_language(rows.select(
        "recording_id", F.concat(F.lit("<|"), "l", F.lit("|>")).alias("lang_token"),
        F.when(F.col("l") == F.col("lang"), 0.7).otherwise(other).alias("prob")))


@query("positional_join", """
    SELECT recording_id, segment_idx AS chunk_idx, text, round_even(start_ms / 7.0, 0) / 1000 AS start,
      round_even(end_ms / 7.0, 0) / 1000 AS "end" FROM utterances""", using=("utterances",))
def positional_join(spark, sf_dir):
    segments = corpus.utterances(spark, sf_dir).withColumnRenamed("segment_idx", "chunk_idx")
    chunks = segments.select("recording_id", "chunk_idx", (F.col("start_ms") / 7.0 / 1000).alias("start"),
                             (F.col("end_ms") / 7.0 / 1000).alias("end"))
    return ql.with_chunk_times(segments.select("recording_id", "chunk_idx", "text"), chunks)


@query("batch_assign", """
    SELECT recording_id, segment_idx AS chunk_idx,
      (row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx) - 1) // 3 AS batch FROM utterances""",
    using=("utterances",))
def batch_assign(spark, sf_dir):
    chunks = corpus.utterances(spark, sf_dir).select("recording_id", F.col("segment_idx").alias("chunk_idx"))
    return ql.batch_of(chunks, 3)


def _requests(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    k, lang = F.col("doc_id") % 6, F.col("lang")
    name = F.when(lang == "en", "English").when(lang == "fr", "French").when(lang == "de", "German").otherwise("Castilian")
    asked = (F.when(k == 0, F.upper(lang)).when(k == 1, name).when(k == 2, "Flemish").when(k == 3, "klingon")
             .when(k == 5, "yue"))
    return docs.select(F.col("doc_id").alias("recording_id"), asked.alias("requested"),
                       F.when(F.col("doc_id") % 5 == 0, "small.en").otherwise("large").alias("model"))


@query("language_norm", "SELECT recording_id, requested, language, unsupported FROM normalised", using=("normalised",))
def language_norm(spark, sf_dir):
    return lg.normalise_languages(_requests(spark, sf_dir)).drop("model")


@query("english_only", """
    SELECT recording_id, model, CASE WHEN model = 'small.en' THEN 'en' ELSE language END AS language,
      model = 'small.en' AND language IS NOT NULL AND language <> 'en' AS overridden FROM normalised""", using=("normalised",))
def english_only(spark, sf_dir):
    return lg.english_only(lg.normalise_languages(_requests(spark, sf_dir))).select(
        "recording_id", "model", "language", "overridden")


@query("model_routing", f"""
    WITH p AS (SELECT * FROM {values_sql(PRIMARY_ALIGN_MODELS)} t(code, name)),
    s AS (SELECT * FROM {values_sql(SECONDARY_ALIGN_MODELS)} t(code, name)),
    r AS (SELECT *, CASE WHEN recording_id % 7 = 0 THEN 'own/model' END AS named FROM normalised)
    SELECT recording_id, coalesce(named, p.name, s.name) AS align_model, coalesce(named, p.name, s.name) IS NULL AS unrouted
    FROM r LEFT JOIN p ON p.code = coalesce(language, 'en') LEFT JOIN s ON s.code = coalesce(language, 'en')""",
    using=("normalised",))
def model_routing(spark, sf_dir):
    named = lg.normalise_languages(_requests(spark, sf_dir)).withColumn(
        "align_model", F.when(F.col("recording_id") % 7 == 0, "own/model"))
    return lg.route_models(named).select("recording_id", "align_model", "unrouted")


@query("lang_dims", f"""
    SELECT doc_id, CASE code WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE 'english' END AS splitter,
      CASE code WHEN 'ja' THEN '、' ELSE ',' END AS comma,
      CASE code WHEN 'en' THEN {len(CONJUNCTIONS['en'])} WHEN 'fr' THEN {len(CONJUNCTIONS['fr'])}
        WHEN 'de' THEN {len(CONJUNCTIONS['de'])} WHEN 'ja' THEN {len(CONJUNCTIONS['ja'])} ELSE 0 END AS n_conjunctions
    FROM (SELECT doc_id, CASE lang WHEN 'es' THEN 'ja' ELSE lang END AS code FROM documents)""")
def lang_dims(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("lang") == "es", "ja").otherwise(F.col("lang")).alias("language"))
    return lg.language_rules(docs).select("doc_id", "splitter", "comma", F.size("conjunctions").alias("n_conjunctions"))


@query("progress_pct", """
    SELECT *, percent / 2 AS first_pass, percent / 2 + 50 AS second_pass FROM (
      SELECT recording_id, segment_idx, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx)::DOUBLE
        / count(*) OVER (PARTITION BY recording_id) * 100 AS percent FROM utterances)""", using=("utterances",))
def progress_pct(spark, sf_dir):
    return pg.percent_done(corpus.utterances(spark, sf_dir))


def progress_events(spark, sf_dir):
    from speechloom.plans.blocks import Scan, blocked_scan

    events = corpus.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"),
        F.when(F.col("event_type") == "view", "segmentation").when(F.col("event_type") == "click", "embeddings")
        .otherwise(F.col("event_type")).alias("step"), corpus.micros(F.col("ts")).alias("t_us"), "event_id")
    return blocked_scan(
        events, ["recording_id", "step"], F.floor(F.col("t_us") / pg.BLOCK_US), ["t_us", "event_id"],
        [Scan("completed", "sum", F.lit(1)), Scan("total", "total", F.lit(1))])


@query("progress_monotone", """
    WITH p AS (
      SELECT recording_id, t_us, event_id, CASE step WHEN 'segmentation' THEN 0.0::DOUBLE + least(completed::DOUBLE / total, 1.0) * 50.0::DOUBLE
        WHEN 'embeddings' THEN 50.0::DOUBLE + least(completed::DOUBLE / total, 1.0) * 49.0::DOUBLE
        ELSE 0.0::DOUBLE + least(completed::DOUBLE / total, 1.0) * 99.0::DOUBLE END AS percent FROM progress_events),
    m AS (SELECT *, coalesce(max(percent) OVER (PARTITION BY recording_id ORDER BY t_us, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS top FROM p)
    SELECT recording_id, t_us, event_id, percent FROM m WHERE percent > top
    UNION ALL SELECT DISTINCT recording_id, NULL, NULL, 100.0::DOUBLE FROM p""", using=("progress_events",))
def progress_monotone(spark, sf_dir):
    return pg.monotone_progress(progress_events(spark, sf_dir), ["t_us", "event_id"], F.floor(F.col("t_us") / pg.BLOCK_US))
