"""String functions: tokens, answers, verdicts, parsers, templates, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators.lexical import words
from retentia.plans.common import MEM, memories
from retentia.plans.registry import Registry
from retentia.sources.tables import table

registry = Registry()
add = registry.add

#: Words without content (fixed values).
STOP = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "by", "with", "from", "is", "are",
    "was", "were", "be", "been", "which", "what", "who", "whom", "whose", "where", "when",
    "how", "did", "does", "do", "that", "this", "as", "and", "or", "it", "its", "their", "his",
    "her", "country", "city",
)
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@add("tokenize", "SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS words FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("words"))


def normalized_answer(x: Column) -> Column:
    """Lower case, articles out first (words in any script), then all but ASCII letters and digits, single spaces."""
    x = F.regexp_replace(F.lower(x), r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def _norm_sql(x: str) -> str:
    # no look-around here: a separator that two articles share is found by the second pass
    once = f"regexp_replace(lower({x}), '(^|[^\\pL\\pM\\pN_])(a|an|the)([^\\pL\\pM\\pN_]|$)', '\\1 \\3', 'g')"
    twice = f"regexp_replace({once}, '(^|[^\\pL\\pM\\pN_])(a|an|the)([^\\pL\\pM\\pN_]|$)', '\\1 \\3', 'g')"
    return f"trim(regexp_replace({twice}, '[^a-z0-9]+', ' ', 'g'))"


@add("normalize_answer", f"SELECT item_id, {_norm_sql('question')} AS question, {_norm_sql('answer')} AS answer FROM eval_items")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", normalized_answer(F.col("question")).alias("question"), normalized_answer(F.col("answer")).alias("answer"))


@add("content_tokens", f"SELECT item_id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(item_text), '[a-z0-9]+')), lambda w: NOT list_contains({_STOP_SQL}, w))) AS words FROM eval_items")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words that aren't stop words."""
    kept = F.array_except(words(F.col("item_text")), F.array(*map(F.lit, STOP)))
    return table(spark, sf_dir, "eval_items").select("item_id", F.array_sort(kept).alias("words"))


@add("answer_present", f"SELECT item_id, contains({_norm_sql('item_text')}, {_norm_sql('answer')}) AND {_norm_sql('answer')} <> '' AS present FROM eval_items")
def answer_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = normalized_answer(F.col("answer"))
    return table(spark, sf_dir, "eval_items").select("item_id", (F.contains(normalized_answer(F.col("item_text")), answer) & (answer != "")).alias("present"))


_MARKS = r"""^["'*`]*(YES|NO)\b"""


def verdict(reply: Column) -> Column:
    """YES or NO as the first whole word behind quotes and marks, else NEUTRAL."""
    first = F.regexp_extract(F.upper(F.btrim(reply, F.lit(" \t\r\n"))), _MARKS, 1)
    return F.when(first != "", first).otherwise("NEUTRAL")


# Replies as a judge writes them, one of several forms by the length of a document.
_REPLY = """CASE n_tokens % 6 WHEN 0 THEN '**YES**, ' || left(text, 40) WHEN 1 THEN ' no.' WHEN 2 THEN '`NO` because ' || left(text, 40) WHEN 3 THEN 'NOT sure' WHEN 4 THEN '"yes"' ELSE text END"""


@add("parse_verdict", f"""WITH v AS (SELECT doc_id, {_REPLY} AS reply FROM documents), f AS (SELECT doc_id, regexp_extract(upper(trim(reply, E' \t\r\n')), '^["''*`]*(YES|NO)\\b', 1) AS f FROM v) SELECT doc_id, CASE WHEN f <> '' THEN f ELSE 'NEUTRAL' END AS verdict FROM f""")
def parse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts read out of replies, here built from the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", verdict(F.expr(_REPLY)).alias("verdict"))


_SCALE = r"(?i)\b1\s*(?:-|–|to)\s*10\b|\bout of\s*10\b|/\s*10\b|\bscale of\b"


def rating(reply: Column, verbose: bool = False) -> Column:
    """The first whole number from 1 to 10; with `verbose` phrases about the scale are taken out first."""
    n = F.regexp_extract(F.regexp_replace(reply, _SCALE, " ") if verbose else reply, r"\b(10|[1-9])\b", 1)
    return F.when(n != "", n.cast("int"))


_RATED = """CASE n_tokens % 5 WHEN 0 THEN 'On a scale of 1 to 10, I would rate this a ' || (n_tokens % 10 + 1) WHEN 1 THEN '1-10: ' || (n_tokens % 10 + 1) WHEN 2 THEN (n_tokens % 12) || '/10' WHEN 3 THEN '' ELSE text END"""


@add(
    "parse_rating",
    f"""WITH v AS (SELECT doc_id, {_RATED} AS reply FROM documents), c AS (SELECT doc_id, reply, regexp_replace(reply, '{_SCALE}', ' ', 'g') AS t FROM v)
    SELECT doc_id, nullif(regexp_extract(reply, '\\b(10|[1-9])\\b', 1), '')::int AS short, nullif(regexp_extract(t, '\\b(10|[1-9])\\b', 1), '')::int AS verbose FROM c""",
)
def parse_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings in the short form and in the verbose one, out of replies built from the documents."""
    reply = F.expr(_RATED)
    return table(spark, sf_dir, "documents").select("doc_id", rating(reply).alias("short"), rating(reply, True).alias("verbose"))


@add(
    "split_documents",
    """SELECT doc_id, regexp_extract(part, '^([0-9]+)', 1)::int AS no, trim(regexp_replace(part, '^[0-9]+:', '')) AS body FROM (SELECT doc_id, unnest(string_split(chr(10) || text, chr(10) || 'Document ')) AS part FROM documents WHERE contains(text, 'Document 1:'))
    WHERE regexp_matches(part, '^[0-9]+:')""",
)
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered parts of texts that hold several documents."""
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("Document 1:")))
    parts = d.select("doc_id", F.explode(F.split(F.concat(F.lit("\n"), "text"), "\nDocument ")).alias("part")).where(F.col("part").rlike("^[0-9]+:"))
    return parts.select("doc_id", F.regexp_extract("part", "^([0-9]+)", 1).cast("int").alias("no"), F.trim(F.regexp_replace("part", "^[0-9]+:", "")).alias("body"))


@add(
    "parse_facts",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE kind = 'fact_list')
    SELECT doc_id, serial, arg_max(fact, pos) AS fact FROM (SELECT doc_id, pos, regexp_extract(line, '^[ \t]*([0-9]{1,9})\\. ', 1)::int AS serial, trim(regexp_extract(line, '^[ \t]*[0-9]+\\. (.*)', 1)) AS fact FROM l WHERE regexp_matches(line, '^[ \t]*[0-9]{1,9}\\. ')) GROUP BY doc_id, serial""",
)
def parse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered facts; of a repeated number the last stands."""
    lines = table(spark, sf_dir, "documents").where("kind = 'fact_list'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.where(F.col("line").rlike(r"^[ \t]*[0-9]{1,9}\. "))
    serial, fact = F.regexp_extract("line", r"^[ \t]*([0-9]{1,9})\. ", 1).cast("int"), F.trim(F.regexp_extract("line", r"^[ \t]*[0-9]+\. (.*)", 1))
    return lines.groupBy("doc_id", serial.alias("serial")).agg(F.max_by(fact, "at").alias("fact"))


@add(
    "parse_chat_time",
    """SELECT doc_id, epoch_us(strptime(stamp, '%Y/%m/%d %H:%M'))::double / 1e6 AS at FROM (SELECT doc_id, regexp_extract(text, 'Chat Time: ([0-9]{4}/[0-9]{2}/[0-9]{2}) \\([A-Za-z]{3}\\) ([0-9]{2}:[0-9]{2})', 1) || ' ' ||
      regexp_extract(text, 'Chat Time: ([0-9]{4}/[0-9]{2}/[0-9]{2}) \\([A-Za-z]{3}\\) ([0-9]{2}:[0-9]{2})', 2) AS stamp FROM documents WHERE regexp_matches(text, 'Chat Time: [0-9]{4}/[0-9]{2}/[0-9]{2} \\([A-Za-z]{3}\\) [0-9]{2}:[0-9]{2}'))""",
)
def parse_chat_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of the first stamp like `Chat Time: 2023/05/21 (Sun) 16:10`, in UTC."""
    pattern = r"Chat Time: ([0-9]{4}/[0-9]{2}/[0-9]{2}) \([A-Za-z]{3}\) ([0-9]{2}:[0-9]{2})"
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(pattern))
    stamp = F.concat_ws(" ", F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2))
    return d.select("doc_id", (F.unix_micros(F.to_timestamp(stamp, "yyyy/MM/dd HH:mm")) / 1e6).alias("at"))


@add(
    "turn_units",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE kind = 'dialogue')
    SELECT doc_id, pos::int AS pos, '[' || regexp_extract(line, '^([A-Z][a-z]+ [0-9]+): ', 1) || '] ' || regexp_replace(line, '^[A-Z][a-z]+ [0-9]+: ', '') AS unit FROM l WHERE regexp_matches(line, '^[A-Z][a-z]+ [0-9]+: ')""",
)
def turn_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit a turn of a dialogue, the speaker in brackets."""
    lines = table(spark, sf_dir, "documents").where("kind = 'dialogue'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = r"^([A-Z][a-z]+ [0-9]+): "
    unit = F.concat(F.lit("["), F.regexp_extract("line", head, 1), F.lit("] "), F.regexp_replace("line", head, ""))
    return lines.where(F.col("line").rlike(head)).select("doc_id", "pos", unit.alias("unit"))


@add("example_units", "SELECT doc_id, trim(part) AS unit FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part FROM documents) WHERE trim(part) <> ''")
def example_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units between blank lines."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n\n")).alias("part"))
    return parts.select("doc_id", F.trim("part").alias("unit")).where("unit <> ''")


@add(
    "source_family",
    "SELECT DISTINCT source, CASE WHEN source LIKE 'eventqa%' OR source LIKE 'ruler%' THEN 'retrieval' WHEN source LIKE 'icl%' THEN 'learning' WHEN source LIKE 'factlist%' THEN 'conflict' ELSE 'other' END AS family FROM memory_units",
)
def source_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    family = F.when(s.startswith("eventqa") | s.startswith("ruler"), "retrieval").when(s.startswith("icl"), "learning").when(s.startswith("factlist"), "conflict").otherwise("other")
    return table(spark, sf_dir, "memory_units").select("source", family.alias("family")).distinct()


@add(
    "gold_fact",
    """WITH a AS (SELECT item_id, answer, regexp_extract_all(lower(question), '[a-z0-9]+') AS qw FROM eval_items WHERE answer <> ''), s AS (SELECT item_id, unnest(string_split(item_text, '. ')) AS sentence, unnest(range(0, len(string_split(item_text, '. ')))) AS no FROM eval_items),
    c AS (SELECT item_id, no, contains(sentence, answer) AS has, len(list_intersect(list_distinct(qw), regexp_extract_all(lower(sentence), '[a-z0-9]+'))) AS overlap FROM s JOIN a USING (item_id))
    SELECT item_id, no::int AS no, overlap::int AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, no DESC) AS rn FROM c WHERE has) WHERE rn = 1""",
)
def gold_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that holds the answer and shares most words with the question, the latest of equals."""
    items = table(spark, sf_dir, "eval_items").where("answer <> ''")
    s = items.select("item_id", "answer", words(F.col("question")).alias("qw"), F.posexplode(F.split("item_text", r"\. ")).alias("no", "sentence"))
    s = s.where(F.contains("sentence", "answer")).withColumn("overlap", F.size(F.array_intersect("qw", words(F.col("sentence")))))
    best = s.groupBy("item_id").agg(F.max(F.struct("overlap", "no")).alias("b"))
    return best.select("item_id", F.col("b.no").alias("no"), F.col("b.overlap").alias("overlap"))


@add("doc_evidence", "WITH h AS (SELECT source, context_index, unit_id, contains(text, 'October') AS hit FROM memory_units WHERE text IS NOT NULL) SELECT source, context_index, unit_id FROM (SELECT *, bool_or(hit) OVER (PARTITION BY source, context_index) AS any_hit FROM h) WHERE hit OR NOT any_hit")
def doc_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a context that bear the answer, or all of them where none does."""
    h = table(spark, sf_dir, "memory_units").where("text IS NOT NULL").select("source", "context_index", "unit_id", F.contains("text", F.lit("October")).alias("hit"))
    any_ = h.groupBy("source", "context_index").agg(F.bool_or("hit").alias("any_hit"))
    return h.join(any_, ["source", "context_index"]).where("hit OR NOT any_hit").select("source", "context_index", "unit_id")


@add("strip_boilerplate", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^<>]+>', '', 'g'), 'Chat Time: [^\n]*\n', '', 'g')) AS body FROM documents WHERE kind = 'prompt'")
def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts without tags and time stamps."""
    body = F.regexp_replace(F.regexp_replace("text", "<[^<>]+>", ""), "Chat Time: [^\n]*\n", "")
    return table(spark, sf_dir, "documents").where("kind = 'prompt'").select("doc_id", F.trim(body).alias("body"))


@add(
    "walkthrough_parse",
    """WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '> go to ([a-z ]+) [0-9]+', 1)) AS place FROM documents WHERE kind = 'task_log') SELECT doc_id, count(*)::bigint AS steps, count(DISTINCT place)::bigint AS places FROM l GROUP BY doc_id""",
)
def walkthrough_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves and different places of a task log."""
    l = table(spark, sf_dir, "documents").where("kind = 'task_log'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("> go to ([a-z ]+) [0-9]+"), F.lit(1))).alias("place"))
    return l.groupBy("doc_id").agg(F.count("*").alias("steps"), F.countDistinct("place").alias("places"))


@add(
    "describe_memory",
    f"""WITH {MEM} SELECT memory_id, CASE WHEN regexp_matches(text_content, 'was on [a-z ]+ [0-9]+') THEN 'location' WHEN regexp_matches(text_content, '(taught|learned|trained)') THEN 'skill' WHEN regexp_matches(text_content, '(prefers|favourite)') THEN 'preference' ELSE 'other' END AS kind,
      regexp_extract(text_content, 'was on ([a-z ]+) [0-9]+', 1) AS place FROM mem WHERE text_content IS NOT NULL""",
)
def describe_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a memory's wording says it is about."""
    t = F.col("text_content")
    kind = F.when(t.rlike("was on [a-z ]+ [0-9]+"), "location").when(t.rlike("(taught|learned|trained)"), "skill").when(t.rlike("(prefers|favourite)"), "preference").otherwise("other")
    return memories(spark, sf_dir).where("text_content IS NOT NULL").select("memory_id", kind.alias("kind"), F.regexp_extract(t, "was on ([a-z ]+) [0-9]+", 1).alias("place"))


@add("keyword_relevance", f"WITH {MEM} SELECT memory_id FROM mem WHERE contains(lower(text_content), 'invoice') OR contains(lower(text_content), 'budgie') OR contains(lower(text_content), 'session')")
def keyword_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that hold any of the keywords."""
    t = F.lower("text_content")
    return memories(spark, sf_dir).where(F.contains(t, F.lit("invoice")) | F.contains(t, F.lit("budgie")) | F.contains(t, F.lit("session"))).select("memory_id")


@add("reformulate_fallback", "SELECT item_id, left(coalesce(nullif(answer, ''), question), 20) AS query FROM eval_items")
def reformulate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reformulation cut to a limit, the raw query where there is none."""
    return table(spark, sf_dir, "eval_items").select("item_id", F.substring(F.coalesce(F.nullif(F.col("answer"), F.lit("")), "question"), 1, 20).alias("query"))


@add("redact_prompts", "SELECT batch_id, line_no, sha256(body) AS digest, length(body)::int AS length FROM collected_requests WHERE body IS NOT NULL")
def redact_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies reduced to digest and length."""
    return table(spark, sf_dir, "collected_requests").where("body IS NOT NULL").select("batch_id", "line_no", F.sha2("body", 256).alias("digest"), F.length("body").alias("length"))


#: Shapes of secrets (fixed values).
SECRETS = {"api_key": r"\bsk-[A-Za-z0-9]{20,}", "cloud_key": r"\bAKIA[0-9A-Z]{16}\b", "token": r"\bgh[pousr]_[A-Za-z0-9]{30,}", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "digest": r"\b[0-9a-f]{64}\b", "ticket": r"\bticket [0-9]{6}\b"}


@add("secret_scan", "SELECT doc_id, kind, n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}'))::int AS n FROM documents" for k, p in SECRETS.items()) + ") WHERE n > 0")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with anything shaped like a secret, by kind; one pass over the texts."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("n")) for k, p in SECRETS.items()))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.*").where("n > 0")


@add("mask_suffix", "SELECT DISTINCT cache_key, '...' || right(cache_key, 4) AS masked FROM vector_cache WHERE length(cache_key) > 4")
def mask_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vector_cache").where(F.length("cache_key") > 4).select("cache_key", F.concat(F.lit("..."), F.right("cache_key", F.lit(4))).alias("masked")).distinct()


@add("sanitize_name", "SELECT context_id, left(regexp_replace(lower(source || ' #' || context_index), '[^a-z0-9_]+', '_', 'g'), 40) || '_' || left(sha256(source || context_index), 8) AS name FROM contexts")
def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store name out of free text: safe letters, bounded, told apart by a digest."""
    index = F.col("context_index").cast("string")
    safe = F.substring(F.regexp_replace(F.lower(F.concat("source", F.lit(" #"), index)), "[^a-z0-9_]+", "_"), 1, 40)
    return table(spark, sf_dir, "contexts").select("context_id", F.concat(safe, F.lit("_"), F.substring(F.sha2(F.concat("source", index), 256), 1, 8)).alias("name"))


_HINT = "CASE n_tokens % 3 WHEN 0 THEN 'Please try again in ' || n_tokens || 'ms.' WHEN 1 THEN 'try again in ' || (n_tokens % 60) || '.5s' ELSE text END"


@add(
    "retry_hint",
    f"""WITH m AS (SELECT doc_id, {_HINT} AS msg FROM documents), p AS (SELECT doc_id, regexp_extract(msg, 'try again in ([0-9.]+)(ms|s)', 1) AS n, regexp_extract(msg, 'try again in ([0-9.]+)(ms|s)', 2) AS unit FROM m)
    SELECT doc_id, CASE WHEN unit = 'ms' THEN try_cast(n AS double) / 1e3 WHEN unit = 's' THEN try_cast(n AS double) END AS seconds FROM p""",
)
def retry_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to wait that an error message names, null where it names none; messages are built from the documents."""
    m = table(spark, sf_dir, "documents").select("doc_id", F.expr(_HINT).alias("msg"))
    n, unit = (F.regexp_extract("msg", "try again in ([0-9.]+)(ms|s)", i) for i in (1, 2))
    return m.select("doc_id", F.when(unit == "ms", n.try_cast("double") / 1e3).when(unit == "s", n.try_cast("double")).alias("seconds"))


@add(
    "session_literals",
    """SELECT context_id, strftime(created_at, '%Y/%m/%d') AS day, (row_number() OVER (PARTITION BY context_id ORDER BY i) - 1)::int AS nth, 'user' AS role, t AS content
    FROM (SELECT context_id, created_at, i, units[i].text AS t FROM (SELECT context_id, created_at, units, unnest(range(1, len(units) + 1)) AS i FROM contexts)) WHERE t IS NOT NULL AND created_at IS NOT NULL""",
)
def session_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns out of literal lists that alternate days and lists of turns, one literal a context, here written from its units."""
    text = lambda u: F.replace(F.replace(F.replace(F.replace(u["text"], F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    turns = F.transform(F.filter("units", lambda u: u["text"].isNotNull()), lambda u: F.concat(F.lit("{'role': 'user', 'content': '"), text(u), F.lit("'}")))
    literal = F.concat(F.lit("['"), F.date_format("created_at", "yyyy/MM/dd"), F.lit("', ["), F.array_join(turns, ", "), F.lit("]]"))
    return literal_turns(table(spark, sf_dir, "contexts").select("context_id", literal.alias("literal")), "context_id", "literal")


def literal_turns(df: DataFrame, key: str, literal: str) -> DataFrame:
    """(key, day, nth, role, content) of literal lists (not JSON, so read in Arrow batches); null and broken ones give no row."""
    import ast

    import pyarrow as pa

    slim = df.select(F.col(key).alias("key"), F.col(literal).alias("literal"))
    kind = slim.schema["key"].dataType.simpleString()

    def parse(batches):
        for batch in batches:
            rows: list[tuple] = []
            for row, text in enumerate(batch.column("literal").to_pylist()):
                try:
                    parts = ast.literal_eval(text) if text is not None else []
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    parts = []
                if not isinstance(parts, list):
                    continue
                for day, turns in zip(parts[::2], parts[1::2]):
                    rows += [(row, str(day), nth, t.get("role"), t.get("content")) for nth, t in enumerate(turns)]
            if rows:
                at, day, nth, role, content = zip(*rows)
                arrays = [batch.column("key").take(pa.array(at)), pa.array(day, pa.string()), pa.array(nth, pa.int32()), pa.array(role, pa.string()), pa.array(content, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "day", "nth", "role", "content"])

    found = slim.mapInArrow(parse, f"key {kind}, day string, nth int, role string, content string")
    return found.withColumnRenamed("key", key)


@add("qa_pairs", "SELECT context_id, (i - 1)::int AS nth, questions[i] AS question FROM (SELECT context_id, questions, unnest(range(1, len(questions) + 1)) AS i FROM contexts)")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of each context, numbered."""
    return table(spark, sf_dir, "contexts").select("context_id", F.posexplode("questions").alias("nth", "question"))


@add("context_units", "SELECT context_id, (i - 1)::int AS unit_no, units[i].text AS text, units[i].unit_ts AS unit_ts FROM (SELECT context_id, units, unnest(range(1, len(units) + 1)) AS i FROM contexts)")
def context_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of each context as rows."""
    u = table(spark, sf_dir, "contexts").select("context_id", F.posexplode("units").alias("unit_no", "unit"))
    return u.select("context_id", "unit_no", F.col("unit.text").alias("text"), F.col("unit.unit_ts").alias("unit_ts"))


@add("extractive_compress")
def extractive_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of long memories kept, in order, while they fit in half the words: too long a sentence is skipped, not the end."""
    m = memories(spark, sf_dir).where("text_content IS NOT NULL").select("memory_id", F.split("text_content", r"(?<=[.!?]) ").alias("s"), F.size(F.split("text_content", " ")).alias("n"))
    zero = F.expr("named_struct('used', 0, 'kept', array())").cast("struct<used:int,kept:array<string>>")

    def step(state, x):
        used = state["used"] + F.size(F.split(x, " "))
        fits = used <= F.col("n") / 2
        return F.struct(F.when(fits, used).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    first = F.array_join(F.slice(F.split(F.element_at("s", 1), " "), 1, F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int"))), " ")
    kept = F.aggregate("s", zero, step)["kept"]
    return m.select("memory_id", F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(first).alias("summary"))


@add("pack_sentences")
def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each unit packed in order into windows of at most 40 words."""
    u = table(spark, sf_dir, "memory_units").where("text IS NOT NULL").select("unit_id", F.split("text", r"(?<=[.!?]) ").alias("s")).distinct()
    zero = F.expr("named_struct('n', 0, 'open', '', 'done', array())").cast("struct<n:int,open:string,done:array<string>>")

    def step(state, x):
        words_ = F.size(F.split(x, " "))
        fits = (state["n"] + words_ <= 40) & (state["n"] > 0)
        open_ = F.when(fits, F.concat_ws(" ", state["open"], x)).otherwise(x)
        done = F.when(fits | (state["n"] == 0), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(F.when(fits, state["n"] + words_).otherwise(words_).alias("n"), open_.alias("open"), done.alias("done"))

    folded = u.select("unit_id", F.aggregate("s", zero, step).alias("f"))
    return folded.select("unit_id", F.posexplode(F.concat("f.done", F.array("f.open"))).alias("nth", "window"))
