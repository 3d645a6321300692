"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm import bpe, chat, exact, html, langid, lattice, merkle, mixing, repeats, shards, simhash, turns, urls
from vitaframe.llm.common import ascii_lower
from vitaframe.sources.tables import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_DRAW = (
    f"('0x' || substr(sha256('{mixing.SEED}:0:' || doc_id) || sha256('{mixing.SEED}:1:' || doc_id), 8 * k + 1, 8))::BIGINT / 4294967296.0"
)


@query(rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
  FROM sized GROUP BY source
), steps AS (
  -- with the k sources of the lowest ceilings (3 sizes a weight) at their ceilings, the share a weight of the others
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS place, coalesce(sum(3 * source_size) OVER before, 0) AS at_cap, coalesce(sum(w) OVER before, 0) AS w_cap,
         (sum(source_size) OVER ()) AS total, (sum(w) OVER ()) AS w_all
  FROM s WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT arg_min((total - at_cap)::BIGINT::DOUBLE / (w_all - w_cap)::BIGINT::DOUBLE, place) AS share FROM steps
  WHERE w * ((total - at_cap)::BIGINT::DOUBLE / (w_all - w_cap)::BIGINT::DOUBLE) <= 3 * source_size
), t AS (
  SELECT source, source_size, CASE WHEN w * share > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE w * share END AS target FROM s, shares
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM t
), drawn AS (
  SELECT doc_id, size, sized.source, source_size, target, k,
         size * (floor(rate)::BIGINT + CASE WHEN {_DRAW} < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source, range({mixing.DRAWS}) r(k)
), nearest AS (
  SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken) - any_value(target)), k) AS place FROM drawn GROUP BY source, k
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken
FROM drawn d JOIN nearest n ON d.source IS NOT DISTINCT FROM n.source AND d.k = n.k AND place = 1
""")
def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of every document."""
    rows = mixing.mixed(mixing.sizes(table(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS).withColumnRenamed("id", "doc_id")


@query()
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query()
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired and rendered."""
    return chat.repaired_chats(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


@query(f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {lattice.LEAST}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
""")
def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    found = lattice.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


#: Bytes of text a shard may hold.
SHARD_BYTES = 1 << 20


@query(f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
b AS (SELECT d, h >> (60 - d) AS p, sum(n)::BIGINT AS bytes, count(*) AS docs FROM r, range(0, 24) t(d) GROUP BY ALL),
f AS (
  SELECT doc_id, n, h, min(d) AS depth FROM r JOIN b ON p = h >> (60 - d) WHERE bytes <= {SHARD_BYTES} OR docs = 1 GROUP BY ALL
)
SELECT doc_id, n AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth::INT, '0') END AS shard,
       depth::INT AS depth, bytes AS shard_bytes, docs AS shard_docs
FROM f JOIN b ON b.d = depth AND b.p = h >> (60 - depth)
""")
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return shards.shards(table(spark, sf_dir, "documents"), SHARD_BYTES).withColumnRenamed("id", "doc_id")


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3)
    bits = F.call_function("lpad", F.lower(F.hex("fp")), F.lit(16), F.lit("0"))
    return found.select(F.col("id").alias("doc_id"), bits.alias("fingerprint"), F.col("component").alias("component_id"))


@query("""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)
""")
def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each equal text stays."""
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query()
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = langid.with_language(docs.select("doc_id", "text"), langid.train(docs))
    doc_id = F.col("_row.doc_id")
    return judged.select(doc_id.alias("doc_id"), langid.held_out(doc_id).alias("held_out"), "lang_pred", "score")


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    byte = "list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)".format(text)
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: {bits}), 4294967295)"


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@query(f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS claim
  FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS part
  FROM d
), low AS (
  SELECT part, 0 AS height, place, leaf AS digest, n FROM l
  UNION ALL
  SELECT part, height + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY part, height, place // 8, n
), top AS (
  SELECT part AS place, 0 AS height, digest, (SELECT count(DISTINCT part) FROM l) AS n FROM low WHERE n = 1
  UNION ALL
  SELECT place // 8, height + 1, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY height, place // 8, n
), nodes AS (
  SELECT part, height, place, digest, n FROM low WHERE n > 1 UNION ALL SELECT -1, height, place, digest, n FROM top WHERE n > 1
), kin AS (
  SELECT part, height, place,
         coalesce(string_agg(digest, '' ORDER BY place) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '' ORDER BY place) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WINDOW run AS (PARTITION BY part, height, place // 8 ORDER BY place)
), climb AS (
  SELECT doc_id, leaf, part, part AS at, 0 AS height, place, n, claim AS h, '' AS proof, 0 AS step FROM l
  UNION ALL
  SELECT c.doc_id, c.leaf, c.part, CASE WHEN c.n = 1 THEN -1 ELSE c.at END, CASE WHEN c.n = 1 THEN 0 ELSE c.height + 1 END, CASE WHEN c.n = 1 THEN c.part ELSE c.place // 8 END,
         CASE WHEN c.n = 1 THEN (SELECT count(DISTINCT part) FROM l) ELSE (c.n + 7) // 8 END,
         CASE WHEN c.n = 1 THEN c.h ELSE sha256(k.l || c.h || k.r) END, CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || k.l || k.r END, step + 1
  FROM climb c LEFT JOIN kin k ON k.part = c.at AND k.height = c.height AND k.place = c.place WHERE c.n > 1 OR c.at >= 0
)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = t.digest AS verified
FROM climb c JOIN low s ON s.n = 1 AND s.part = c.part JOIN top t ON t.n = 1 WHERE c.at = -1 AND c.n = 1
""")
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document checked against the manifest, a third of them after tampering."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.when(text.isNotNull(), ascii_lower(text))).otherwise(text)
    return merkle.checked(docs, now={"text": tampered}).withColumnRenamed("id", "doc_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a hash of conversation and turn: dropped, emptied, cut off, repeated, user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy"))


# SQL parses from left to right: states are 1 start, 2 after system, 3 after user, 4 after assistant, and q[state] is
# the cheapest (cost, audit) that leads there, null where none does.
def _cell(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda c: c IS NOT NULL))"


def _plus(state: int, cost: str, letter: str, when: str = "TRUE") -> str:
    return f"CASE WHEN q[{state}] IS NOT NULL AND ({when}) THEN {{'cost': q[{state}].cost + {cost}, 'audit': q[{state}].audit || '{letter}'}} END"


def _edit_or(state: int, before: list[tuple[int, str]], may: str) -> str:
    """A state's cell after a row: the row deleted, or kept or given another role on a move into the state."""
    options = [_plus(state, "4", "D")]
    for p, initial in before:
        options.append(_plus(p, "extra", "K", f"{may} AND initial = '{initial}'"))
        if initial != "s":
            options.append(_plus(p, "extra + 3", "R", f"{may} AND initial <> '{initial}'"))
    return _cell(*options)


def _inserted(state: int, before: list[int]) -> str:
    return _cell(f"q[{state}]", *[_plus(p, "3", "I") for p in before])


_AFTER_ROW = "[" + ", ".join(_edit_or(k, b, "fault NOT IN ('b', 'd')") for k, b in ((1, []), (2, [(1, "s")]), (3, [(1, "u"), (2, "u"), (4, "u")]), (4, [(3, "a")]))) + "]"
_AFTER_INSERTION = "[q[1], q[2], " + _inserted(3, [1, 2, 4]) + ", " + _inserted(4, [3]) + "]"


@query(rf"""
WITH RECURSIVE planted AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f
  FROM conversations
), rows AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM planted, range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM rows
), timed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS time FROM placed
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN time > 1 THEN 'd'
                 WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault,
         substr(role, 1, 1) AS initial, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS following
  FROM timed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), steps AS (  -- one step for a row, then three for insertions, which lead from any state to any later one
  SELECT conv_id, place, k, initial, fault, CASE fault WHEN 't' THEN 3 ELSE 0 END AS extra, 4 * place + k AS step FROM judged, range(4) t(k)
  UNION ALL SELECT conv_id, 0, k, '', '', 0, k FROM counts, range(1, 4) t(k)
), best AS (
  SELECT conv_id, 0 AS step, [{{'cost': 0, 'audit': ''}}, NULL, NULL, NULL] AS q FROM counts
  UNION ALL
  SELECT b.conv_id, b.step + 1, CASE WHEN s.k = 0 THEN {_AFTER_ROW} ELSE {_AFTER_INSERTION} END
  FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.step = b.step + 1
), least AS (
  SELECT b.conv_id, {_cell("q[1]", "q[4]")} AS c FROM best b JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND step = 4 * n + 3
), letters AS (
  SELECT conv_id, k, c.audit[k] AS letter, count(*) FILTER (c.audit[k] <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS place
  FROM least, range(1, len(c.audit) + 1) t(k)
), kept AS (
  SELECT l.conv_id, k, letter, role, text, row_number() OVER (PARTITION BY l.conv_id ORDER BY k) AS i,
         first_value(letter = 'K' AND role LIKE 's%') OVER (PARTITION BY l.conv_id ORDER BY k) AS system
  FROM letters l LEFT JOIN judged j ON l.conv_id IS NOT DISTINCT FROM j.conv_id AND l.place = j.place AND letter <> 'I' WHERE letter <> 'D'
), said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role || ':' || text WHEN (i - system::INT) % 2 = 1 THEN 'user:' || coalesce(text, '') ELSE 'assistant:' || coalesce(text, '') END, chr(10) ORDER BY k) AS said
  FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(c.cost, 0)::BIGINT AS cost, coalesce(c.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN least ON o.conv_id IS NOT DISTINCT FROM least.conv_id LEFT JOIN said ON o.conv_id IS NOT DISTINCT FROM said.conv_id
""")
def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired after planted damage."""
    conversations = table(spark, sf_dir, "conversations")
    found = turns.repaired(damaged(conversations)).withColumnRenamed("conv", "_conv")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (  -- a window is cut out of a piece, as finding a place in a string takes time that grows with the place
  SELECT r, c, n, substr(h, 500 * c + 1, 500 + {2 * repeats.LENGTH}) AS p FROM (SELECT r, h, len(h) // 2 AS n, unnest(range(0, len(h) // 500 + 1)) AS c FROM d)
), w AS (
  SELECT r, 250 * c + k AS i, hash(substr(p, 2 * k + 1, {2 * repeats.LENGTH})) AS s FROM pieces, range(250) t(k) WHERE 250 * c + k + {repeats.LENGTH} <= n
), twice AS (
  SELECT r, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
), starts AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {repeats.LENGTH} THEN 0 ELSE 1 END AS fresh FROM twice
), numbered AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM starts
), spans AS (
  SELECT r, run, min(i) AS a, max(i) + {repeats.LENGTH} AS b, coalesce(lag(max(i)) OVER (PARTITION BY r ORDER BY run) + {repeats.LENGTH}, 0) AS before
  FROM numbered GROUP BY r, run
), cut AS (
  SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept
  FROM spans JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
""")
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that occur twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.without_repeats(docs)
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
