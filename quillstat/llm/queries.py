"""The opN_ queries over the tables of a scale-factor folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quillstat.llm import curriculum, warc
from quillstat.llm._tables import crc_mod
from quillstat.llm.decontaminate import contaminated
from quillstat.llm.exact_dedup import exact_groups, normalised
from quillstat.llm.html_text import extract
from quillstat.llm.licenses import LICENSE_SQL, scan_licenses, template_table
from quillstat.llm.ngram_jaccard import jaccard_components
from quillstat.llm.quality import score_quality
from quillstat.llm.substring_dedup import remove_repeats
from quillstat.llm.toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _verdict(scored: DataFrame, score: str, held_out, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _verdict(scored, "toxicity_score", held_out, 0.7)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), template_table(spark))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    return exact_groups(table(spark, sf_dir, "documents"), carry={"text_sha256": digest}).drop("full_hash")


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.documents_in_training_order(curriculum.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "repeat_position")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _verdict(scored, "quality_score", held_out, 0.3)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_license_scan": op4_license_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_curriculum_mix": op6_curriculum_mix,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_html_text": op9_html_text,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

EXACT_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256 from d
"""

JACCARD_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
e as (select doc_id, unnest(s) as g from s),
n as (select doc_id, len(s)::bigint as n_shingles from s),
p as (select a.doc_id as u, b.doc_id as v, count(*) as inter from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * inter >= 75 * (a.n_shingles + b.n_shingles - inter)),
g as (select u, v from l union all select v, u from l),
c(node, root) as (select doc_id, doc_id from n union select g.v, c.root from c join g on g.u = c.node)
select n.doc_id, n_shingles, min(root) as component_id from n join c on c.node = n.doc_id group by 1, 2
"""

SUBSTRING_SQL = r"""
with w as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents),
x as (select r, s, array_to_string(w[s:s+34], ' ') as g from w, unnest(range(1, len(w) - 33)) as t(s)),
g as (select g from x group by g having count(*) > 1),
c as (select distinct r, p from (select r, unnest(range(s, s + 35)) as p from x semi join g on x.g = g.g)),
k as (select r, list(p) as gone, count(*) as n from c group by r)
select doc_id, len(w)::bigint as n_words, coalesce(k.n, 0)::bigint as n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)), ' ')) as kept_sha256 from w left join k on k.r = w.r
"""

WARC_SQL = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as h, min(page_id) over (partition by sha256(b)) as f from p)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(h, ((i // 4) * 5 + 1)::int, 5))::bigint >> ((3 - i % 4) * 5)::int) & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id = f then null else f end as refers_to from d
"""

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING_SQL,
    "op3_warc": WARC_SQL,
    "op4_license_scan": LICENSE_SQL,
    "op5_exact_dedup": EXACT_SQL,
    "op6_curriculum_mix": curriculum.MIX_SQL.format(docs="documents"),
    "op10_ngram_jaccard": JACCARD_SQL,
}
