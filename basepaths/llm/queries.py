"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basepaths.llm import licenses, pair_maxscore, residue_mining

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_simhash_near_dedup")
def op8(spark, sf_dir):
    from basepaths.llm import simhash_index

    return simhash_index.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination")
def op4(spark, sf_dir):
    from basepaths.llm import decontaminate

    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_pivotal_mixing")
def op5(spark, sf_dir):
    from basepaths.llm import mixing

    return mixing.mix_documents(table(spark, sf_dir, "documents")).drop("source")


@query("op3_pu_toxicity")
def op3(spark, sf_dir):
    from basepaths.llm import toxicity

    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_byte_cnn_quality")
def op9(spark, sf_dir):
    from basepaths.llm import byte_cnn

    return byte_cnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_fuzzy_line_dedup")
def op2(spark, sf_dir):
    from basepaths.llm import fuzzy_lines

    return fuzzy_lines.line_dedup(table(spark, sf_dir, "documents"))


@query("op7_suffix_array_dedup")
def op7(spark, sf_dir):
    from basepaths.llm import suffix_dedup

    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


@query("op6_quotation_linking")
def op6(spark, sf_dir):
    from basepaths.llm import quotes

    return quotes.conversations(table(spark, sf_dir, "conversations"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_SHINGLES = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"


def _license_sql() -> str:
    """Every window of every template, without MinHash."""
    rows = ", ".join(f"('{name}', '{text}')" for name, text in licenses.TEMPLATES.items())
    return f"""
with t(template, text) as (values {rows}),
g0 as (select template, list_distinct({_SHINGLES}) as tsh, len(w) - 4 as m from (select template, {_WORDS} as w from t) a),
g as (select *, cast(ceil(m / 4.0) as int) + 1 as step, m + cast(ceil(m / 4.0) as int) as span from g0),
d as (select doc_id, {_SHINGLES} as sh from (select doc_id, {_WORDS} as w from documents) a where len(w) >= 5),
w as (select doc_id, template, tsh, pos, sh[pos + 1:pos + span] as part from (
  select *, unnest(range(0, len(sh), step)) as pos from d join g on list_has_any(sh, tsh)) a),
s as (select doc_id, template, pos, len(list_intersect(tsh, part)) / len(tsh) as containment from w)
select doc_id, template, max(containment) as containment, cast(arg_min(pos, struct_pack(c := -containment, a := pos)) as int) as first_word
from s where containment >= {licenses.CONTAINMENT} group by doc_id, template"""


@query("op10_license_scan", _license_sql())
def op10(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op1_embedding_near_dedup", """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
ok as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id
  and case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= 0.9 else false end),
reach(id, other) as (select vec_id, vec_id from v union select r.id, p.b from reach r join p on r.other = p.a)
select v.vec_id, coalesce(n, 0) as n_links, component_id, v.vec_id = component_id as kept
from v join (select id, min(other) as component_id from reach group by id) c on c.id = v.vec_id
left join (select a, count(*) as n from p group by a) l on l.a = v.vec_id""")
def op1(spark, sf_dir):
    from basepaths.llm import embedding_graph

    return embedding_graph.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_paragraph_sketches")
def op11(spark, sf_dir):
    from basepaths.llm import paragraph_sketch

    return paragraph_sketch.edited_documents(table(spark, sf_dir, "documents"))


@query("op12_residue_hard_negatives", residue_mining.SQL)
def op12(spark, sf_dir):
    return residue_mining.mine_embeddings(table(spark, sf_dir, "embeddings"))


@query("op13_pair_maxscore_search", pair_maxscore.SQL)
def op13(spark, sf_dir):
    return pair_maxscore.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
