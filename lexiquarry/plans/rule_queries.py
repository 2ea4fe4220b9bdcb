"""More queries with their SQL: text rules on values of the fixed lists, windows, relocation, policies, audits and training sets.

Where a rule speaks of words that the tables lack, its subjects are made from
the fixed lists, one for each row of a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import bio, dataset, linking, profile, spans, tokens
from . import pipelines
from .queries import ANN, SQL, TOK, annotated, docs, query, table, token_rows


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def pick(values: list[str], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(number) % len(values) + 1).cast("int"))


def sql_pick(values: list[str], number: str) -> str:
    return f"{listed(values)}[({number} % {len(values)} + 1)::INT]"


def re2(pattern: str) -> str:
    """A Java pattern of the lexicon for DuckDB: without the flags for Unicode, which its library always heeds or lacks."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace(r"\b", r"(?:^|$|\s)").replace("'", "''")


# --- text rules -----------------------------------------------------------------

MENTIONS = ["  Bệnh nhân bị lao phổi", "bệnh lý gan, không đặc hiệu", "Hội chứng thận hư", "mắc bệnh gout", "nghi ngờ viêm, chưa xác định", "tiểu đường", "thiếu men G6PD", "ho", "Siêu âm bụng", "bịho và ĐauĐầu nhiều", "đáiTháo đường", "thuốc", "HỆ SAU", "X-quang ngực"]
_GLUED = "m"
for _k, _v in L.GLUED_WORDS.items():
    _GLUED = f"regexp_replace({_GLUED}, {quote(f'(?i){_k}')}, {quote(_v)}, 'g')"
_WHOLE = "CASE low " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in L.SYNONYMS_SHORT.items()) + " ELSE low END"


@query(rf"""WITH t AS (SELECT p_partkey, {sql_pick(MENTIONS, "p_partkey")} AS m FROM part), l AS (SELECT *, lower(trim(m)) AS low FROM t)
SELECT p_partkey, {_WHOLE} AS whole, regexp_replace(low, '{re2(L.DIAGNOSIS_PREFIX)}', '') AS bare, regexp_replace(low, '{re2(L.TRAILING_QUALIFIER)}', '') AS unqualified,
  trim(regexp_replace(low, '{re2(L.KEY_PREFIX)}', '')) AS key, {_GLUED} AS unglued, list_has_any({listed(list(L.TEST_KEYWORDS))}, list_filter({listed(list(L.TEST_KEYWORDS))}, lambda k: contains(low, k))) AS is_test,
  low IN ({", ".join(map(quote, L.COMMON_SYMPTOMS))}) AS is_symptom, low IN ({", ".join(map(quote, L.DRUG_BLACKLIST))}) AS listed FROM l""")
def mention_rules(spark, sf_dir):
    """Whole-word synonyms, prefixes, qualifiers, dictionary keys, glued words, and the lists of tests, symptoms and drugs."""
    m = table(spark, sf_dir, "part").select("p_partkey", pick(MENTIONS, "p_partkey").alias("m"))
    low = X.lower_strip(F.col("m"))
    return m.select(
        "p_partkey", X.replace_whole(low, L.SYNONYMS_SHORT).alias("whole"), X.strip_diagnosis_prefix(low).alias("bare"), X.strip_trailing_qualifier(low).alias("unqualified"),
        X.strip_key_prefix(low).alias("key"), X.split_glued(F.col("m")).alias("unglued"), X.is_test_name(low).alias("is_test"), X.is_common_symptom(low).alias("is_symptom"), low.isin(*L.DRUG_BLACKLIST).alias("listed"),
    )


TERMS = [*L.PLAIN_SYMPTOMS, "viêm gan", "Đau ngực trái", "GOUT", "cao huyết áp", "Khó thở "]


def _terms(spark, sf_dir) -> DataFrame:
    """An entity for each document, its text one of TERMS."""
    kind = F.when(F.col("n_chars") % 3 == 0, L.SYMPTOM).otherwise(L.DIAGNOSIS)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).cast("long").alias("ord"), pick(TERMS, "doc_id").alias("text"), kind.alias("type"))
    none = F.array().cast("array<string>")
    return rows.withColumns({"assertions": none, "candidates": F.array(F.lit("A1*"), F.lit(""))})


TERM_SQL = f"t AS (SELECT doc_id, {sql_pick(TERMS, 'doc_id')} AS text, CASE WHEN n_chars % 3 = 0 THEN '{L.SYMPTOM}' ELSE '{L.DIAGNOSIS}' END AS type FROM documents)"


@query(f"""WITH {TERM_SQL}, c AS (SELECT type, trim(lower(text)) AS text FROM t)
SELECT text, count(*) AS n FROM c WHERE type = '{L.DIAGNOSIS}' AND text IN ({", ".join(map(quote, L.PLAIN_SYMPTOMS))}) GROUP BY ROLLUP (text)""")
def corrupted_symptoms(spark, sf_dir):
    return profile.corrupted_symptoms(_terms(spark, sf_dir))


RESTORED = f"""{TERM_SQL}, r AS (SELECT *, type = '{L.DIAGNOSIS}' AND trim(lower(text)) NOT IN ({", ".join(map(quote, L.KEPT_DIAGNOSES))})
  AND len(list_filter({listed(list(L.RESTORED_SYMPTOMS))}, lambda s: contains(trim(lower(text)), s) OR contains(s, trim(lower(text))))) > 0 AS restored FROM t)"""


@query(f"WITH {RESTORED} SELECT doc_id, restored, CASE WHEN restored THEN '{L.SYMPTOM}' ELSE type END AS type, CASE WHEN restored THEN 0 ELSE 2 END AS codes FROM r")
def symptom_restoration(spark, sf_dir):
    return spans.restore_symptoms(_terms(spark, sf_dir)).select("doc_id", "restored", "type", F.size("candidates").alias("codes"))


@query(f"""WITH {RESTORED} SELECT count(*) AS entities, count(*) FILTER (restored) AS symptom_restores, count(*) FILTER (type = '{L.DIAGNOSIS}' AND NOT restored) AS candidate_updates FROM r""")
def repair_counts(spark, sf_dir):
    """Repair against an empty dictionary: the diagnoses that stay keep their own codes, cleaned."""
    before = _terms(spark, sf_dir).withColumns({"start": F.lit(0), "end": F.lit(1)})
    none = spark.createDataFrame([], "name string, code string, ord long")
    return pipelines.repair_counts(before, pipelines.repair(before, none, none))


# --- windows and relocation ---------------------------------------------------------


@query(f"SELECT doc_id, chunk_no, start_offset + 3 AS start, start_offset + 7 AS \"end\" FROM ({SQL['chunk_windows']}) WHERE end_offset - start_offset >= 900")
def chunk_rebase(spark, sf_dir):
    """A place in each chunk, in document positions; chunks of under 900 characters give it without an end, and it goes."""
    windows = tokens.word_windows(docs(spark, sf_dir))
    local = windows.select("doc_id", "chunk_no", "start_offset", F.lit(3).alias("start"), F.when(F.col("end_offset") - F.col("start_offset") >= 900, 7).alias("end"))
    return tokens.rebase(local).select("doc_id", "chunk_no", "start", "end")


@query(rf"""WITH {ANN}, j AS (SELECT a.doc_id, a.ord, a.s + 1 AS s, a.e + 1 AS e, a.text, d.text AS doc FROM a JOIN documents d USING (doc_id)),
f AS (SELECT *, s < e AND e <= length(doc) AND lower(substring(doc, s + 1, e - s)) = lower(text) AS good, instr(lower(doc), lower(text)) - 1 AS pos FROM j)
SELECT doc_id, ord, (CASE WHEN NOT good AND pos >= 0 THEN pos ELSE s END)::INT AS start, (CASE WHEN NOT good AND pos >= 0 THEN pos + length(text) ELSE e END)::INT AS "end" FROM f""")
def first_hit_relocation(spark, sf_dir):
    """Spans that are one character off, moved to the first place of their text."""
    a, _ = annotated(spark, sf_dir)
    moved = spans.first_hit(a.withColumns({"start": F.col("start") + 1, "end": F.col("end") + 1}), docs(spark, sf_dir))
    return moved.select("doc_id", "ord", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


WINDOWS = r"""WITH RECURSIVE {tok}, n AS (SELECT doc_id, max(ord) + 1 AS n FROM tok GROUP BY 1),
p AS (SELECT f.doc_id, f.ord AS f, f.s, greatest(f.ord, max(l.ord)) AS l FROM tok f JOIN tok l ON l.doc_id = f.doc_id AND l.ord BETWEEN f.ord AND f.ord + {many} WHERE l.ord = f.ord OR {fits} GROUP BY 1, 2, 3),
w AS (SELECT doc_id, 0 AS chunk_no, f, s, l FROM p WHERE f = 0
  UNION ALL SELECT p.doc_id, w.chunk_no + 1, p.f, p.s, p.l FROM w JOIN n ON n.doc_id = w.doc_id JOIN p ON p.doc_id = w.doc_id AND p.f = greatest(w.l + 1 - {overlap}, w.f + 1) WHERE w.l + 1 < n.n),
c AS (SELECT w.doc_id, chunk_no, w.s AS start_offset, t.e - w.s AS chars FROM w JOIN tok t ON t.doc_id = w.doc_id AND t.ord = w.l
  UNION ALL SELECT doc_id, 0, 0, least(length(coalesce(text, '')), 600) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n))
SELECT doc_id, chunk_no::INT AS chunk_no, start_offset::INT AS start_offset, ({chars})::INT AS chars FROM c"""
SQL["bounded_chunks"] = WINDOWS.format(tok=TOK, many=119, fits="l.e - f.s <= 450", overlap=30, chars="CASE WHEN chars > 450 AND doc_id IN (SELECT doc_id FROM n) THEN 450 ELSE chars END")
MARKS = r"""
pieces AS (SELECT doc_id, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]') AS x FROM documents)),
ends AS (SELECT doc_id, w, k, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM pieces),
marks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, w AS word, (e - length(w))::INT AS s, e::INT AS e FROM ends WHERE NOT regexp_matches(w, '^\s'))
"""
SQL["token_budget_chunks"] = WINDOWS.format(
    tok=MARKS + ", tok AS (SELECT *, sum(ceil(length(word) / 4.0)) OVER (PARTITION BY doc_id ORDER BY ord) AS spent, ceil(length(word) / 4.0) AS cost FROM marks)",
    many=239, fits="l.spent - f.spent + f.cost <= 240", overlap=60, chars="CASE WHEN doc_id IN (SELECT doc_id FROM n) AND chars > 960 THEN chars - 10 * ceil((chars - 960) / 10.0) ELSE chars END",
)

SQL["span_coalesce"] = rf"""WITH RECURSIVE {ANN}, o AS (SELECT a.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY s, ord) AS k, s, e, type FROM a),
h AS (SELECT o.*, CASE WHEN type = lag(type) OVER w AND s - lag(e) OVER w <= 3 AND NOT contains(substring(d.text, lag(e) OVER w + 1, greatest(s - lag(e) OVER w, 0)), chr(10)) THEN 0 ELSE 1 END AS head
  FROM o JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY o.doc_id ORDER BY k)),
i AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM h), j AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY k) AS n FROM i),
r AS (SELECT doc_id, island, n, k, s AS s0, k AS k0, e, type FROM j WHERE n = 1
  UNION ALL SELECT j.doc_id, j.island, j.n, j.k, CASE WHEN j.e - r.s0 <= 50 THEN r.s0 ELSE j.s END, CASE WHEN j.e - r.s0 <= 50 THEN r.k0 ELSE j.k END, j.e, j.type FROM r JOIN j ON j.doc_id = r.doc_id AND j.island = r.island AND j.n = r.n + 1),
g AS (SELECT doc_id, k0, any_value(s0) AS s, arg_max(e, k) AS e, any_value(type) AS type FROM r GROUP BY 1, 2)
SELECT g.doc_id, row_number() OVER (PARTITION BY g.doc_id ORDER BY k0) - 1 AS ord, s::BIGINT AS start, e::BIGINT AS "end", substring(d.text, s + 1, greatest(e - s, 0)) AS text, type FROM g JOIN documents d USING (doc_id)"""

SQL["bio_examples"] = rf"""WITH {ANN}, m AS (WITH {MARKS} SELECT * FROM marks),
i AS (SELECT m.doc_id, m.ord, row_number() OVER (PARTITION BY a.doc_id, a.ord ORDER BY m.ord) AS k FROM m JOIN a ON a.doc_id = m.doc_id AND m.s >= a.s AND m.e <= a.e),
heads AS (SELECT doc_id, count(DISTINCT ord) AS n FROM i WHERE k = 1 GROUP BY 1), c AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1)
SELECT c.doc_id, c.n::INT AS n_tokens, coalesce(heads.n, 0)::INT AS n_entities FROM c LEFT JOIN heads USING (doc_id)"""


# --- linking --------------------------------------------------------------------------

NAMES = "n AS (SELECT lower(trim(p_name)) AS name, arg_min(p_partkey, p_partkey)::VARCHAR AS code, min(p_partkey) AS ord FROM part GROUP BY 1)"
EDITS = "1 - levenshtein(q, name) / greatest(length(q), length(name))"


def _names(spark, sf_dir) -> DataFrame:
    return linking.first_wins(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("code"), F.col("p_partkey").alias("ord")))


@query(f"""WITH {NAMES}, f AS (SELECT DISTINCT trim(lower(unnest([p_name, left(p_name, 6), left(p_name, 3) || substring(p_name, 5)]))) AS q FROM part),
e AS (SELECT q, code, 'exact' AS layer FROM f JOIN n ON q = name), r1 AS (SELECT q FROM f WHERE q <> '' AND q NOT IN (SELECT q FROM e)),
s AS (SELECT q, arg_min(code, ord) AS code, 'substring' AS layer FROM r1, n WHERE length(q) >= 3 AND (contains(name, q) OR contains(q, name)) GROUP BY q), r2 AS (SELECT q FROM r1 WHERE q NOT IN (SELECT q FROM s)),
z AS (SELECT q, arg_max(code, ({EDITS}, name, ord)) AS code, 'fuzzy' AS layer FROM r2, n WHERE {EDITS} >= 0.8 GROUP BY q)
SELECT q, '{L.DRUG}' AS type, code, layer FROM (SELECT * FROM e UNION ALL SELECT * FROM s UNION ALL SELECT * FROM z)""")
def link_cascade_edits(spark, sf_dir):
    """The cascade with the edit distance as its fuzzy layer."""
    names = _names(spark, sf_dir)
    forms = F.explode(F.array("p_name", F.expr("substring(p_name, 1, 6)"), F.expr("concat(substring(p_name, 1, 3), substring(p_name, 5))")))
    mentions = table(spark, sf_dir, "part").select(forms.alias("text"), F.lit(L.DRUG).alias("type"))
    return linking.cascade(mentions, names, names, full=False, use_substring=True, cutoff=0.80, scorer="edits")


@query(f"""WITH {NAMES}, dx AS (SELECT * FROM n WHERE length(name) % 2 = 0), rx AS (SELECT * FROM n WHERE length(name) % 2 = 1),
f AS (SELECT DISTINCT trim(lower(unnest([p_name, left(p_name, length(p_name) - 1)]))) AS q FROM part),
h AS (SELECT q, 1 AS layer FROM f JOIN dx ON q = name UNION ALL SELECT q, 2 FROM f, dx WHERE {EDITS} >= 0.9 UNION ALL SELECT q, 3 FROM f JOIN rx ON q = name UNION ALL SELECT q, 4 FROM f, rx WHERE {EDITS} >= 0.9)
SELECT q, CASE WHEN min(layer) <= 2 THEN '{L.DIAGNOSIS}' ELSE '{L.DRUG}' END AS type FROM h GROUP BY q""")
def type_override(spark, sf_dir):
    """Names of even length stand for diagnoses, the others for drugs; mentions are the names, whole and less a letter."""
    names = _names(spark, sf_dir)
    even = F.length("name") % 2 == 0
    mentions = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.expr("substring(p_name, 1, length(p_name) - 1)"))).alias("text"))
    return linking.override_type(mentions, names.where(even), names.where(~even), 0.9, "edits")


@query(f"""WITH {NAMES}, m AS (SELECT p_partkey, lower(trim(p_name)) AS q, CASE WHEN p_partkey % 3 = 0 THEN '{L.SYMPTOM}' ELSE '{L.DRUG}' END AS type FROM part),
j AS (SELECT m.*, n.code FROM m LEFT JOIN n ON n.name = m.q AND length(n.name) % 2 = 0), p AS (SELECT *, unnest(['database', 'keep', 'overwrite']) AS policy FROM j)
SELECT p_partkey, policy, CASE WHEN type = '{L.DRUG}' AND code IS NOT NULL THEN code WHEN policy = 'overwrite' OR (policy = 'database' AND type <> '{L.DRUG}') THEN '' WHEN policy = 'database' THEN 'A1' ELSE 'A1*,' END AS codes FROM p""")
def candidate_policies(spark, sf_dir):
    """Codes of each part's name under the three policies; only names of even length are in the dictionary."""
    kind = F.when(F.col("p_partkey") % 3 == 0, L.SYMPTOM).otherwise(L.DRUG)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), kind.alias("type"), F.array(F.lit("A1*"), F.lit("")).alias("candidates"))
    links = linking.exact(rows.select(F.lower("text").alias("q")).distinct(), _names(spark, sf_dir).where(F.length("name") % 2 == 0)).withColumn("type", F.lit(L.DRUG))
    each = [linking.link(rows, links, full=False, policy=p).withColumn("policy", F.lit(p)) for p in ("database", "keep", "overwrite")]
    return dataset.union_all(each).select("p_partkey", "policy", F.array_join("candidates", ",").alias("codes"))


AUDIT = f"""WITH {ANN}, x AS (SELECT doc_id, ord, text, CASE WHEN length(text) % 5 = 0 THEN ['A1*'] WHEN length(text) % 5 = 1 THEN [] ELSE ['C3'] END AS own, CASE WHEN length(text) % 2 = 0 THEN ['A1'] ELSE [] END AS want FROM a WHERE type = '{L.DRUG}'),
y AS (SELECT *, list_transform(own, lambda c: replace(c, '*', '')) <> want AS wrong FROM x)"""


def _audited(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a, _ = annotated(spark, sf_dir)
    r, none = F.length("text") % 5, F.array().cast("array<string>")
    own = a.withColumn("candidates", F.when(r == 0, F.array(F.lit("A1*"))).when(r == 1, none).otherwise(F.array(F.lit("C3"))))
    return own, a.select("doc_id", "ord", F.when(F.length("text") % 2 == 0, F.array(F.lit("A1"))).otherwise(none).alias("candidates"))


@query(f"""{AUDIT} SELECT count(*) AS eligible, count(*) FILTER (len(own) = 0) AS empty, count(*) FILTER (wrong) AS wrong, count(*) FILTER (wrong) / count(*) * 100 AS wrong_pct, count(*) FILTER (len(own) = 0) / count(*) * 100 AS empty_pct FROM y""")
def linker_audit(spark, sf_dir):
    return profile.discrepancy_report(*_audited(spark, sf_dir), ["doc_id", "ord"])


@query(f"""{AUDIT} SELECT doc_id, ord, text, array_to_string(own, ',') AS own, array_to_string(want, ',') AS expected FROM y WHERE wrong ORDER BY doc_id, ord LIMIT 15""")
def linker_samples(spark, sf_dir):
    """The audit's first fifteen discrepancies, its feature."""
    own, want = _audited(spark, sf_dir)
    found = profile.discrepancies(own.where(F.col("type") == L.DRUG), want, ["doc_id", "ord"]).select("doc_id", "ord", "text", F.array_join("candidates", ",").alias("own"), F.array_join("expected", ",").alias("expected"))
    return profile.preview(found, ["doc_id", "ord"], 15)


@query(rf"""WITH {ANN} SELECT count(*) AS entities, count(*) FILTER (length(text) % 3 <> 0) AS linked, max(doc_id) AS last_doc FROM a""")
def run_counters(spark, sf_dir):
    """What an observation counts while the rows are written nowhere."""
    a, _ = annotated(spark, sf_dir)
    codes = F.when(F.length("text") % 3 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows, seen = profile.observed(a.withColumn("candidates", codes))
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["entities"], got["linked"], got["last_doc"])], "entities long, linked long, last_doc long")


# --- tags and training sets -------------------------------------------------------------


@query(rf"""WITH {TOK}, tags AS (SELECT doc_id, ord, word, s, CASE WHEN word NOT LIKE '%,%' THEN e END AS e, CASE WHEN regexp_matches(word, '^[a-c]') THEN 'B-{L.DRUG}' WHEN regexp_matches(word, '^[d-k]') THEN 'I-{L.DRUG}' WHEN regexp_matches(word, '^[l-r]') THEN 'I-{L.SYMPTOM}' ELSE 'O' END AS tag FROM tok),
t AS (SELECT *, CASE WHEN tag <> 'O' THEN substring(tag, 3) END AS type FROM tags),
h AS (SELECT *, CASE WHEN type IS NULL OR (tag LIKE 'I-%' AND lag(type) OVER d IS NOT DISTINCT FROM type) THEN 0 ELSE 1 END AS begin_ FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY ord)),
i AS (SELECT *, sum(begin_) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM h),
g AS (SELECT doc_id, island, type, min(s) AS start, arg_max(e, ord) FILTER (true) AS e0, max(ord) AS last, string_agg(word, ' ' ORDER BY ord) AS text FROM i WHERE type IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT g.*, i.e AS "end" FROM g JOIN i ON i.doc_id = g.doc_id AND i.ord = g.last WHERE i.e IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS ord, start, "end", text, type FROM k""")
def grouped_annotations(spark, sf_dir):
    """Pieces of a token classifier grouped to entities; a piece with a comma has no end, and a group that ends with it goes."""
    def one(x):
        w = x["word"]
        tag = F.when(w.rlike("^[a-c]"), f"B-{L.DRUG}").when(w.rlike("^[d-k]"), f"I-{L.DRUG}").when(w.rlike("^[l-r]"), f"I-{L.SYMPTOM}").otherwise("O")
        return F.struct(w.alias("word"), tag.alias("tag"), x["start"].alias("start"), F.when(~F.contains(w, F.lit(",")), x["end"]).alias("end"))

    return bio.group_lists(token_rows(spark, sf_dir).select("doc_id", F.transform("t", one).alias("t")))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS top FROM e),
x AS (SELECT vec_id, list_transform(v, lambda y: exp(y - top)) AS p FROM m) SELECT vec_id, round(list_max(p) / list_sum(p), 9) AS best, list_position(p, list_max(p))::INT AS label FROM x""")
def softmax_labels(spark, sf_dir):
    """The most probable component of each vector, taken as scores."""
    p = bio.softmax(F.col("embedding").cast("array<double>"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    return rows.select("vec_id", F.round(F.array_max("p"), 9).alias("best"), F.array_position("p", F.array_max("p")).cast("int").alias("label"))


@query("""WITH t AS (SELECT source AS stem, arg_max(doc_id, lpad(doc_id::VARCHAR, 12, '0')) AS text_of FROM documents GROUP BY 1),
l AS (SELECT d.source AS stem, arg_max(l.doc_id, lpad(l.doc_id::VARCHAR, 12, '0')) AS label_of FROM labels l JOIN documents d USING (doc_id) GROUP BY 1)
SELECT stem, text_of, label_of FROM t JOIN l USING (stem)""")
def paired_files(spark, sf_dir):
    """Documents and labels as files whose stem is their source: the last path of a stem counts."""
    path = lambda c: F.lpad(F.col(c).cast("string"), 12, "0").alias("path")
    d = table(spark, sf_dir, "documents")
    texts = d.select(F.col("source").alias("stem"), path("doc_id"), F.col("doc_id").alias("text_of"))
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().join(d.select("doc_id", "source"), "doc_id").select(F.col("source").alias("stem"), path("doc_id"), F.col("doc_id").alias("label_of"))
    return dataset.pair_by_stem(texts, labels)


@query("SELECT 10 * count(*) // 10 AS rows, 0 AS shared, true AS about_a_tenth FROM orders")
def split_sides(spark, sf_dir):
    """The 90/10 split of the orders: all rows, none on both sides, a tenth within a hundredth held out."""
    train, held = dataset.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    both = train.withColumn("side", F.lit(0)).union(held.withColumn("side", F.lit(1)))
    keys = both.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.count_distinct("side").alias("sides"), F.max("side").alias("held"))
    return keys.agg(F.sum("n").alias("rows"), F.count_if(F.col("sides") > 1).alias("shared"), (F.abs(F.avg("held") - 0.1) < 0.01).alias("about_a_tenth"))

