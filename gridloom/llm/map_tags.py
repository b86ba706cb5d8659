"""Queries p1 and p4: tags of map features, over all current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.cooccur import associations, pair_counts
from gridloom.llm.frequency import dictionary_frequencies, term_frequencies, usefulness_mark
from gridloom.llm.resolve import current_dictionaries, current_features, dictionary_terms


def p1_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag of the current dictionaries: occurrences, features, features of the kind, mark."""
    terms = dictionary_terms(current_dictionaries(spark, sf_dir))
    counted = dictionary_frequencies(terms, term_frequencies(current_features(spark, sf_dir)))
    return counted.select("kind", F.col("term").alias("tag"), "n_occ", "n_rec", "n", usefulness_mark().alias("mark"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_frequencies(spark, sf_dir).where("mark is not null").select("kind", "tag", "mark")


def p4_pairs(spark: SparkSession, sf_dir: str, least: int = 1, per_mille: int = 0, lift: int = 0) -> DataFrame:
    """Every pair of tags carried by one feature, with its counts and its ratio to chance."""
    counts = pair_counts(current_features(spark, sf_dir))
    scored = associations(counts, least, per_mille)
    # n_ab n >= lift n_a n_b in whole numbers: the ratio as a double could round across the limit
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("n_ab", "n_a", "n_b", "n")}
    cases = scored.where(wide["n_ab"] * wide["n"] >= lift * (wide["n_a"] * wide["n_b"])) if lift else scored
    terms = dictionary_terms(current_dictionaries(spark, sf_dir))
    for side in "ab":
        name = terms.select(F.col("kind").alias("__k"), F.col("id").alias("__i"), F.col("term").alias(f"term_{side}"))
        cases = cases.join(name, (F.col("kind") == F.col("__k")) & (F.col(side) == F.col("__i"))).drop("__k", "__i")
    swap = F.col("term_b") < F.col("term_a")
    return cases.select(
        "kind",
        F.least("term_a", "term_b").alias("tag_a"),
        F.greatest("term_a", "term_b").alias("tag_b"),
        "n_ab",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        "n",
        "lift",
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir, least=5, per_mille=1, lift=4).select("kind", "tag_a", "tag_b")


_RESOLVED = """with h as (select map_id, poi_tags, way_tags from map_header qualify row_number() over (partition by map_id order by written_at desc nulls last) = 1),
d as (select map_id, 'poi' kind, list_transform(poi_tags, lambda x: lower(trim(x))) terms from h union all select map_id, 'way', list_transform(way_tags, lambda x: lower(trim(x))) from h),
f as (select 'poi' kind, map_id, si, tile_x, tile_y, zi, ord, tags from poi
  qualify row_number() over (partition by map_id, si, tile_x, tile_y, zi, ord order by loaded_at desc nulls last) = 1
union all select 'way', map_id, si, tile_x, tile_y, zi, ord, tags from way
  qualify row_number() over (partition by map_id, si, tile_x, tile_y, zi, ord order by loaded_at desc nulls last) = 1),
g as (select f.kind, row_number() over () rec, list_filter(list_transform(tags, lambda t: case when t >= 0 and t < len(d.terms) then d.terms[t + 1] end), lambda x: x is not null) terms
  from f left join d on f.map_id = d.map_id and f.kind = d.kind),
nk as (select kind, count(*) n from g group by kind)
"""
P1_FREQ_SQL = (
    _RESOLVED
    + """, u as (select kind, rec, unnest(terms) tag from g), c as (select kind, tag, count(*) n_occ, count(distinct rec) n_rec from u group by kind, tag),
t as (select distinct kind, tag from (select kind, unnest(terms) tag from d) where tag is not null),
r as (select t.kind, t.tag, coalesce(c.n_occ, 0)::bigint n_occ, coalesce(c.n_rec, 0)::bigint n_rec, coalesce(nk.n, 0)::bigint n
  from t left join c on t.kind = c.kind and t.tag = c.tag left join nk on t.kind = nk.kind)
select *, case when n_rec < 5 then 'rare' when 4 * n_rec > n then 'common' end mark from r"""
)
P1_SQL = f"select kind, tag, mark from ({P1_FREQ_SQL}) where mark is not null"
P4_PAIRS_SQL = (
    _RESOLVED
    + """, u as (select kind, rec, unnest(list_distinct(terms)) tag from g), c as (select kind, tag, count(*) n from u group by kind, tag),
p as (select x.kind, x.tag tag_a, y.tag tag_b, count(*) n_ab from u x join u y on x.rec = y.rec and x.tag < y.tag group by all)
select p.kind, p.tag_a, p.tag_b, p.n_ab::bigint n_ab, a.n::bigint n_a, b.n::bigint n_b, nk.n::bigint n, p.n_ab::double * nk.n / (a.n::double * b.n) lift
from p join c a on p.kind = a.kind and p.tag_a = a.tag join c b on p.kind = b.kind and p.tag_b = b.tag join nk on p.kind = nk.kind"""
)
P4_SQL = f"select kind, tag_a, tag_b from ({P4_PAIRS_SQL}) where n_ab >= 5 and 1000 * n_ab >= n and n_ab * n >= 4 * n_a * n_b"

QUERIES = {"p1_found": p1_found, "p1_frequencies": p1_frequencies, "p4_found": p4_found, "p4_pairs": p4_pairs}
ORACLES = {"p1_found": P1_SQL, "p1_frequencies": P1_FREQ_SQL, "p4_found": P4_SQL, "p4_pairs": P4_PAIRS_SQL}
