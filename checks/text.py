"""Text operators over whole documents and conversations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import kit as K
from checks import views as V
from leadlens import lexicon as lx
from leadlens.functions import codec
from leadlens.functions import domains as D
from leadlens.functions import text as X
from leadlens.functions import times as TM
from leadlens.operators import ingest as I
from leadlens.sources import redact as R

# The test texts are invented words in four languages, so the tiers get words that occur in them.
TEST_LEXICON = replace(
    lx.Lexicon(),
    zh_strong=("ßbe", "öpf", "ueci"),
    zh_weak=("ierê", "çeau", "éonç"),
    ru=("cióne", "ezción", "llgaue"),
    en_strong=("free", "therha", "license"),
    en_weak=("tion the", "heat", "ingwh", "shand", "$"),
    models=("tion", "heit", "ción", "eau", "the", "ung"),
)
TEST_KEY_LINES = r"(?i)(token|secret|password)\s*[=:]\s*\S{10,}"


def _texts(spark, sf):
    """Every document and every conversation turn as (key, text)."""
    d = V.text_table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    c = V.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"), "text"
    )
    return d.unionByName(c)


def detect_language(spark, sf):
    return _texts(spark, sf).select("key", X.detect_lang(F.col("text")).alias("lang"))


def detect_language_posts(spark, sf):
    return V.posts(spark, sf).select("ingest_seq", X.detect_lang(F.col("raw_text")).alias("lang"))


def _prefilter(spark, sf, lex):
    m = _texts(spark, sf).select("key", X.prefilter(F.col("text"), lex).alias("m"))
    return m.select("key", F.col("m.ok").alias("ok"), F.array_join("m.hits", ",").alias("hits"))


def prefilter_hits(spark, sf):
    return _prefilter(spark, sf, lx.Lexicon())


def prefilter_hits_test_words(spark, sf):
    return _prefilter(spark, sf, TEST_LEXICON)


def prefilter_hits_long_lists(spark, sf):
    """The test words among thousands of others, which occur nowhere."""
    more = tuple(f"{k}§{k * 7919 % 10007}§" for k in range(5000))
    return _prefilter(spark, sf, replace(TEST_LEXICON, en_strong=TEST_LEXICON.en_strong + more, ru=TEST_LEXICON.ru + more))


def keyword_models(spark, sf):
    found = X.find_models(F.col("text"), TEST_LEXICON.models)
    return _texts(spark, sf).select("key", F.array_join(found, ",").alias("models"))


def keyword_counts(spark, sf):
    """Texts per model keyword."""
    labels = _texts(spark, sf).select(F.explode(X.find_models(F.col("text"), TEST_LEXICON.models)).alias("model"))
    return labels.groupBy("model").agg(F.count("*").alias("count"))


def signal_dedup(spark, sf):
    """First document per source and text."""
    return I.first_per_key(V.document_signals(spark, sf)).select("source", F.col("ingest_seq").alias("doc_id"))


def new_signals(spark, sf):
    """First documents per source and text that are not among the labelled (already stored) ones."""
    docs = V.document_signals(spark, sf)
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("ingest_seq"))
    stored = docs.join(labels, "ingest_seq", "left_semi")
    rows = docs.withColumn("blocked", F.lit(False))
    return I.storable(rows, stored).select("source", F.col("ingest_seq").alias("doc_id"))


def early_keys(spark, sf):
    d = V.document_signals(spark, sf)
    none = F.lit(None).cast("string")
    url = F.when(F.col("ingest_seq") % 3 == 0, F.col("source_url"))
    return d.select(
        F.col("ingest_seq").alias("doc_id"), I.early_key(F.col("source"), none, url, F.col("raw_text")).alias("early_key")
    )


def redacted_documents(spark, sf):
    return R.redact_documents(V.text_table(spark, sf, "documents"), TEST_KEY_LINES).select("doc_id", F.md5("text").alias("digest"))


def redacted_documents_default(spark, sf):
    return R.redact_documents(V.text_table(spark, sf, "documents")).select("doc_id", F.md5("text").alias("digest"))


def bare_domains(spark, sf):
    """Domains named in documents, conversations and page texts without a scheme (e-mail hosts included where
    the rules see them)."""
    pages = V.text_table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("text"))
    both = _texts(spark, sf).unionByName(pages)
    return both.select("key", F.posexplode(D.bare_domains(F.col("text"))).alias("pos", "domain"))


def timestamp_forms(spark, sf):
    """Stored, ISO, offset and broken renderings of event times, read back."""
    e = V.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    raw = (
        F.when(F.col("event_id") % 5 == 0, TM.to_storage(F.col("ts")))
        .when(F.col("event_id") % 5 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 5 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("event_id") % 5 == 3, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .otherwise("not a time")
    )
    rows = e.withColumn("raw", raw)
    return rows.select(
        "event_id",
        TM.to_storage(TM.parse_utc(F.col("raw"))).alias("utc"),
        TM.to_storage(TM.parse_naive(F.col("raw"))).alias("naive"),
        TM.to_iso(F.col("raw")).alias("iso"),
    )


def json_codec(spark, sf):
    """Stored JSON read back: documents parse, anything else stays as it is; documents are written again."""
    e = V.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 4 == 0, codec.encoded_text(F.col("event_type"))).otherwise(F.col("props"))
    back = e.select("event_id", codec.decoded(raw, "k bigint").alias("d"))
    return back.select("event_id", F.col("d.value.k").alias("k"), F.col("d.text").alias("kept_text"))


QUERIES = {
    f.__name__: f
    for f in (
        detect_language, detect_language_posts, prefilter_hits, prefilter_hits_test_words, prefilter_hits_long_lists, keyword_models, keyword_counts,
        signal_dedup, new_signals, early_keys, redacted_documents, redacted_documents_default, bare_domains,
        timestamp_forms, json_codec,
    )
}

# ------------------------------------------------------------------ SQL
_TEXTS = """texts AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS key, text FROM documents
  UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations
)"""
_LANG = """CASE WHEN coalesce({t}, '') = '' THEN 'en' WHEN regexp_matches({t}, '[一-鿿]') THEN 'zh'
  WHEN len(regexp_extract_all({t}, '[Ѐ-ӿ]')) > len(regexp_extract_all({t}, '[A-Za-z]')) THEN 'ru' ELSE 'en' END"""


def prefilter_sql(text: str, lex: lx.Lexicon) -> str:
    """SQL list of the deciding words (empty = rejected) for a text column; needs its lower case in ``low``."""
    money = K.quoted(lex.money_pattern.replace("(?iU)", "(?i)"))
    weak = f"list_concat({K.word_hits('low', lex.en_weak)}, CASE WHEN regexp_matches({text}, {money}) THEN ['$money'] ELSE [] END)"
    return f"""CASE WHEN {K.any_word('low', lex.zh_strong)} THEN list_slice({K.word_hits('low', lex.zh_strong)}, 1, 1)
      WHEN len({K.word_hits('low', lex.zh_weak)}) >= 2 THEN {K.word_hits('low', lex.zh_weak)}
      WHEN {K.any_word('low', lex.ru)} THEN {K.word_hits('low', lex.ru)}
      WHEN {K.any_word('low', lex.en_strong)} THEN {K.word_hits('low', lex.en_strong)}
      WHEN len({weak}) >= 2 THEN {weak} ELSE [] END"""


def _prefilter_oracle(lex):
    return f"""WITH {_TEXTS}, lowered AS (SELECT key, text, lower(text) AS low FROM texts),
hit AS (SELECT key, {prefilter_sql('text', lex)} AS h FROM lowered)
SELECT key, len(h) > 0 AS ok, array_to_string(h, ',') AS hits FROM hit"""


_MODEL_HITS = K.word_hits("lower(text)", sorted(TEST_LEXICON.models))
_DOC_KEYS = "docs AS (SELECT source, 'doc://' || md5(text) AS source_url, doc_id, text FROM documents)"
_LINES = r"string_split(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10))"


def _redacted(pattern):
    return f"""SELECT doc_id, md5(array_to_string(list_filter({_LINES}, lambda l: NOT regexp_matches(l, {K.quoted(pattern)})), chr(10))) AS digest
FROM documents"""


# No look-behind in this engine: the character before a domain is part of the match and must not be '@', a letter
# or a digit.
_TLD = "(?:ai|io|com|net|org|dev|app|co|in|xyz|gg|sh|me|cloud|tech|so|chat|run|top|pro|cc)"
_LABEL = "[a-z0-9]{2}[a-z0-9-]{0,60}[a-z0-9]"
_BARE = rf"(?i)(?:^|[^0-9a-z_\pL\pN@])((?:{_LABEL}\.)+{_TLD})(?:$|[^0-9a-z_\pL\pN])"

ORACLE = {
    "detect_language": f"WITH {_TEXTS} SELECT key, {_LANG.format(t='text')} AS lang FROM texts",
    "detect_language_posts": f"WITH {V.POSTS_SQL} SELECT ingest_seq, {_LANG.format(t='raw_text')} AS lang FROM posts",
    "prefilter_hits": _prefilter_oracle(lx.Lexicon()),
    "prefilter_hits_test_words": _prefilter_oracle(TEST_LEXICON),
    "keyword_models": f"WITH {_TEXTS} SELECT key, array_to_string({_MODEL_HITS}, ',') AS models FROM texts",
    "keyword_counts": f"""WITH {_TEXTS}
SELECT model, count(*) AS count FROM (SELECT unnest({_MODEL_HITS}) AS model FROM texts) GROUP BY 1""",
    "signal_dedup": f"WITH {_DOC_KEYS} SELECT source, min(doc_id) AS doc_id FROM docs GROUP BY source, source_url",
    "new_signals": f"""WITH {_DOC_KEYS},
stored AS (SELECT DISTINCT source, source_url FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT d.source, min(d.doc_id) AS doc_id FROM docs d
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = d.source AND s.source_url = d.source_url)
GROUP BY d.source, d.source_url""",
    "early_keys": f"""WITH {_DOC_KEYS}
SELECT doc_id, source || '|' || coalesce(CASE WHEN doc_id % 3 = 0 THEN source_url END, sha256(text)) AS early_key FROM docs""",
    "redacted_documents": _redacted(TEST_KEY_LINES),
    "redacted_documents_default": _redacted(lx.KEY_LINE_PATTERN.replace("(?iU)", "(?i)")),
    "bare_domains": f"""WITH {_TEXTS}, src AS (SELECT key, text FROM texts UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages),
found AS (SELECT key, regexp_extract_all(text, {K.quoted(_BARE)}, 1) AS hosts FROM src)
SELECT key, CAST(unnest(range(len(hosts))) AS INTEGER) AS pos, lower(unnest(hosts)) AS domain FROM found""",
    "timestamp_forms": """
WITH f AS (SELECT event_id, event_id % 5 AS k, ts, date_trunc('second', ts) AS sec FROM events)
SELECT event_id,
  CASE k WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN 3 THEN strftime(sec - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f')
    WHEN 4 THEN NULL ELSE strftime(sec, '%Y-%m-%d %H:%M:%S.%f') END AS utc,
  CASE k WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN 4 THEN NULL ELSE strftime(sec, '%Y-%m-%d %H:%M:%S.%f') END AS naive,
  CASE k WHEN 0 THEN CASE WHEN ts = sec THEN strftime(sec, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END
    WHEN 4 THEN NULL ELSE strftime(sec, '%Y-%m-%dT%H:%M:%S') END AS iso
FROM f""",
    "json_codec": """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 4 = 0 THEN event_type END AS kept_text FROM events""",
}
ORACLE["prefilter_hits_long_lists"] = ORACLE["prefilter_hits_test_words"]
