"""Queries of the rule, count and report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import edges as E
from ..operators import match as M
from ..operators import report as R
from . import twins
from .registry import query
from .twins import TRIPLES_SQL

COLOURS = {"warm": ["red", "hot"], "cool": ["blue", "cold"]}


LISTED = rules.NON_POINT_LABELS
VALID_SQL = f"""not (x = '' or x in ({", ".join(f"'{w}'" for w in LISTED)}) or {" or ".join(f"starts_with(x, '{w.strip()}')" if w.strip() == w else f"starts_with(x, '{w}')" for w in rules.NON_POINT_PREFIXES)}
or regexp_matches(x, '^例[0-9]') or regexp_matches(x, '^第[一二三四五六七八九十0-9]+章') or regexp_matches(x, '^[0-9]+([.][0-9]+)*$'))"""
#: Parts under names that the rule takes out by each of its branches, and their own.
POINTS_SQL = f"""points as (select p_partkey, trim(case p_partkey % 10 when 1 then p_size::varchar || '.' || (p_partkey % 7)::varchar when 2 then '1.' || p_size::varchar || '.3' when 3 then p_size::varchar when 4 then '例' || p_size::varchar || ' ' || p_name
when 5 then '第' || p_size::varchar || '章 ' || p_name when 6 then ' ' || list_extract([{", ".join(f"'{w}'" for w in LISTED)}], (p_size % {len(LISTED)} + 1)::int) || ' ' when 7 then list_extract([{", ".join(f"'{w}'" for w in rules.NON_POINT_PREFIXES)}], (p_size % {len(rules.NON_POINT_PREFIXES)} + 1)::int) || p_name when 8 then '1.' || p_name else p_name end) as x from part)"""


def points(t):
    n = F.col("p_size").cast("string")
    listed, prefixes = (F.array(*[F.lit(w) for w in words]) for words in (rules.NON_POINT_LABELS, rules.NON_POINT_PREFIXES))
    at = lambda words: F.get(words, (F.col("p_size") % F.size(words)).cast("int"))
    kinds = [
        F.concat(n, F.lit("."), (F.col("p_partkey") % 7).cast("string")), F.concat(F.lit("1."), n, F.lit(".3")), n, F.concat(F.lit("例"), n, F.lit(" "), "p_name"),
        F.concat(F.lit("第"), n, F.lit("章 "), "p_name"), F.concat(F.lit(" "), at(listed), F.lit(" ")), F.concat(at(prefixes), "p_name"), F.concat(F.lit("1."), "p_name"),
    ]
    label = F.col("p_name")
    for k, kind in enumerate(kinds):
        label = F.when(F.col("p_partkey") % 10 == k + 1, kind).otherwise(label)
    return t.part.select("p_partkey", label.alias("label"))


@query("f1_valid_points", f"with {POINTS_SQL} select p_partkey, {VALID_SQL} as valid from points")
def f1(t):
    return points(t).select("p_partkey", T.is_valid_point(F.col("label")).alias("valid"))


@query("f2_filter_stats", f"with {POINTS_SQL} select count(*) as total, count(*) filter (where not v) as removed, count(distinct x) filter (where not v) as removed_labels from (select x, {VALID_SQL} as v from points)")
def f2(t):
    v = T.is_valid_point(F.col("label"))
    return points(t).agg(F.count("*").alias("total"), F.count_if(~v).alias("removed"), F.count_distinct(F.when(~v, F.trim("label"))).alias("removed_labels"))


@query("f3_f4_clean_sections", """select p_partkey, p_size::varchar || '.' || (p_partkey % 7)::varchar || '-' || p_name || ':' as original_label, p_name as label, p_size::varchar || '.' || (p_partkey % 7)::varchar as order_in_book, true as cleaned from part""")
def f3(t):
    raw = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit("-"), F.col("p_name"), F.lit(":"))
    d = t.part.select("p_partkey", raw.alias("original_label"), T.clean_section(raw).alias("c"))
    return d.select("p_partkey", "original_label", "c.label", "c.order_in_book", (F.col("c.label") != F.col("original_label")).alias("cleaned"))


@query("f5_generic_chapters", "select p_partkey, p_name, p_name like '%ring' or p_name like '%bolt' as generic from part")
def f5(t):
    return t.part.select("p_partkey", "p_name", T.has_suffix(F.col("p_name"), ["ring", "bolt"]).alias("generic"))


@query("f6_quality_issues", r"select doc_id, (case when regexp_matches(text, '\s\s') then 1 else 0 end + case when regexp_matches(text, '\s$') then 1 else 0 end)::int as issues from documents where regexp_matches(text, '\s\s') or regexp_matches(text, '\s$')")
def f6(t):
    return t.documents.select("doc_id", F.size(T.quality_issues(F.col("text"))).alias("issues")).where("issues > 0")


@query("f7_topics", "select p_partkey, case when contains(p_name, 'red') or contains(p_name, 'hot') then 'warm' when contains(p_name, 'blue') or contains(p_name, 'cold') then 'cool' else 'other' end as topic from part")
def f7(t):
    return t.part.select("p_partkey", T.first_keyword(F.col("p_name"), COLOURS, "other").alias("topic"))


@query("f8_difficulty", "select p_partkey, greatest(1, least(5, case p_type when 'SMALL' then 1 when 'LARGE' then 4 else 3 end + contains(p_name, 'gear')::int + contains(p_name, 'hot')::int - contains(p_name, 'small')::int))::int as difficulty from part")
def f8(t):
    return t.part.select("p_partkey", T.difficulty(F.col("p_name"), F.col("p_type"), {"SMALL": 1, "LARGE": 4}, ["gear", "hot"], ["small"]).alias("difficulty"))


@query("f9_importance", "select p_partkey, case when contains(p_name, 'gear') then 'core' when contains(p_name, 'bolt') or contains(p_name, 'rod') then 'important' else 'known' end as importance from part")
def f9(t):
    return t.part.select("p_partkey", T.first_keyword(F.col("p_name"), {"core": ["gear"], "important": ["bolt", "rod"]}, "known").alias("importance"))


@query("f10_f12_subjects", TRIPLES_SQL + r" select subject, count(*) as n from (select coalesce(nullif(regexp_extract(s, 'instance/([^/#]+)[/#]', 1), ''), 'unknown') as subject from triples) group by subject")
def f10(t):
    return R.counts(twins.triples(t).select(T.subject_of_uri(F.col("s")).alias("subject")), "subject")


@query("f11_subject_of_name", "select c_custkey, case when contains(c_mktsegment, 'AUTO') then 'cars' when contains(c_mktsegment, 'MACH') then 'machines' else 'unknown' end as subject from customer")
def f11(t):
    return t.customer.select("c_custkey", T.first_keyword(F.col("c_mktsegment"), {"cars": ["AUTO"], "machines": ["MACH"]}, "unknown").alias("subject"))


@query("f13_j1_label_match", "select p.p_partkey, replace(lower(trim(p.p_name)), ' ', '') as norm, d.norm is not null as matched from part p left join (select distinct replace(lower(p_name), ' ', '') as norm from part where p_size > 45) d on replace(lower(trim(p.p_name)), ' ', '') = d.norm")
def f13(t):
    from ..operators import match as M

    items = t.part.select("p_partkey", T.normal_label(F.col("p_name")).alias("norm"))
    return M.exact(items, t.part.where("p_size > 45").select(T.normal_label(F.col("p_name")).alias("norm")), "norm")


@query("f14_uri_parts", "select page_id, regexp_extract(url, '://([^/]+)/', 1) as domain, regexp_extract(url, '://[^/]+/(.*)', 1) as suffix from pages")
def f14(t):
    return t.pages.select("page_id", T.uri_parts(F.col("url")).alias("u")).select("page_id", "u.domain", "u.suffix")


@query("f15_a5_predicate_profile", TRIPLES_SQL + " select p, count(*) as n, round(avg(starts_with(o, 'http')::int::double), 6) as entity_ratio, case when avg(starts_with(o, 'http')::int::double) >= 0.2 then 'object' else 'data' end as kind from triples group by p")
def a5(t):
    return R.predicate_profile(twins.triples(t), T.is_entity(F.col("o"), ["http"]))


@query("f16_punctuation", r"select doc_id, length(regexp_replace(text, '[!-/:-@\[-`{-~]+', '', 'g'))::int as kept from documents")
def f16(t):
    return t.documents.select("doc_id", F.char_length(T.without_punctuation(F.col("text"))).alias("kept"))


@query("f17_uri_safe", "select distinct p_name, trim(replace(replace(replace(p_name || ' (' || p_type || '):', ' ', '_'), '(', ''), ')', ''), '_:') as safe from part")
def f17(t):
    return t.part.select("p_name", T.uri_safe(F.concat("p_name", F.lit(" ("), "p_type", F.lit("):"))).alias("safe")).distinct()


@query("f18_ids", "select n_nationkey, case n_regionkey when 0 then 'af' else n_regionkey::varchar end || '-' || n_name as id, 'urn:kg#textbook-primary-' || lpad(n_nationkey::varchar, 5, '0') as uri from nation")
def f18(t):
    code = T.coded(F.col("n_regionkey").cast("string"), {"0": "af"})
    return t.nation.select("n_nationkey", T.child_id(code, F.col("n_name")).alias("id"), T.point_uri("urn:kg", F.lit("primary"), F.col("n_nationkey")).alias("uri"))


@query("f19_parse_ids", "select c_custkey, 'pub' || c_nationkey::varchar as publisher, 'g' || (c_custkey % 9 + 1)::varchar as grade, case when c_custkey % 2 = 0 then 's' else 'x' end as semester from customer")
def f19(t):
    tb = F.concat(F.lit("pub"), F.col("c_nationkey").cast("string"), F.lit("-g"), (F.col("c_custkey") % 9 + 1).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "s").otherwise("x"))
    return t.customer.select("c_custkey", T.parse_textbook_id(tb).alias("x")).select("c_custkey", "x.*")


@query("f20_core_concepts", "select p_partkey, not (contains(p_name, 'ring') or contains(p_name, 'hot')) and length(p_name) between 1 and 10 as core from part")
def f20(t):
    return t.part.select("p_partkey", T.is_core_concept(F.col("p_name"), ["ring", "hot"], 1, 10).alias("core"))


@query("f21_confidence", "select event_id, coalesce(try_cast(x as double), case lower(x) when 'high' then 0.9::double when 'medium' then 0.6::double when 'low' then 0.3::double end, 0.5::double) as conf from (select event_id, case event_id % 4 when 0 then 'High' when 1 then 'low' when 2 then value::varchar else 'none' end as x from events)")
def f21(t):
    k = F.col("event_id") % 4
    x = F.when(k == 0, "High").when(k == 1, "low").when(k == 2, F.col("value").cast("string")).otherwise("none")
    return t.events.select("event_id", T.confidence(x).alias("conf"))


@query("f22_tolerant_json", "select event_id, (props::json->>'k')::bigint as k from events")
def f22(t):
    p, k = F.col("props"), F.col("event_id") % 4
    raw = F.when(k == 0, p).when(k == 1, F.concat(F.lit("Answer: "), p, F.lit(" done"))).when(k == 2, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).otherwise(F.translate(p, '"', "'"))
    return t.events.select("event_id", T.tolerant_json(raw, "k bigint").getField("k").alias("k"))


@query("f23_hashes", "select doc_id, substr(sha256(text), 1, 16) as key, md5(text) as id from documents")
def f23(t):
    return t.documents.select("doc_id", T.short_hash(F.col("text")).alias("key"), F.md5("text").alias("id"))


@query("f24_f25_bands", "select event_id, case when value >= 20 then 'high' when value >= 5 then 'medium' else 'low' end as band from events")
def f24(t):
    return t.events.select("event_id", T.band(F.col("value"), {"high": 20, "medium": 5}, "low").alias("band"))


@query("f26_stages", "select o_orderkey, case when contains(lower(o_orderpriority), 'high') then 'high' end as stage from orders")
def f26(t):
    return t.orders.select("o_orderkey", T.school_stage(F.col("o_orderpriority")).alias("stage"))


@query("f27_grades_of_urls", r"""select page_id, case when n between 19 and 30 then 'primary' when n between 31 and 36 then 'middle' end as stage,
case when n between 19 and 30 then ((n - 19) // 2 + 1)::varchar || '年级' when n between 31 and 36 then ((n - 31) // 2 + 7)::varchar || '年级' end as grade
from (select page_id, try_cast(regexp_extract(url, '/([0-9]+)\.html', 1) as int) as n from pages)""")
def f27(t):
    return t.pages.select("page_id", T.grade_of_url(F.col("url")).alias("g")).select("page_id", "g.stage", "g.grade")


@query("f28_headings", "select p_partkey, case when p_partkey % 2 = 0 then 'chapter' else 'subsection' end as kind from part")
def f28(t):
    h = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_name"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".1 "), F.col("p_name")))
    return t.part.select("p_partkey", T.heading_kind(h).alias("kind"))


@query("f29_rhetorical_type", "select doc_id, case when source = 'src0' then 'garbage' when contains(text, 'this') then 'definition' when contains(text, 'with') then 'property' else 'concept' end as kind from documents")
def f29(t):
    x = F.when(F.col("source") != "src0", F.col("text"))
    return t.documents.select("doc_id", F.when(x.isNull(), "garbage").otherwise(T.first_keyword(x, {"definition": ["this"], "property": ["with"]}, "concept")).alias("kind"))


@query("f30_drop_garbage", "select count(*) as n from (select distinct l_suppkey, l_partkey from lineitem) where l_partkey not in (select p_partkey from part where p_size < 10)")
def f30(t):
    g = t.part.where("p_size < 10").select(F.col("p_partkey").alias("g"))
    e = twins.related(t)
    return e.join(g, e.dst == g.g, "left_anti").agg(F.count("*").alias("n"))


@query("f31_version_tags", "select page_id, case when contains(url, 'www') then '0.2' when contains(url, 'example') then '0.1' else 'none' end as version from pages")
def f31(t):
    return t.pages.select("page_id", T.version_tag(F.col("url"), {"0.2": "www", "0.1": "example"}).alias("version"))


@query("f32_spans", r"select doc_id, count(*) as n from (select doc_id, trim(unnest(string_split_regex(text, '[。，.\n]')), ' ') as x from documents) where x <> '' group by doc_id")
def f32(t):
    return t.documents.select("doc_id", F.explode(T.spans(F.col("text"))).alias("x")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f33_missing_points", "select o.o_orderkey from orders o left join lineitem l on o.o_orderkey = l.l_orderkey where o.o_orderstatus = 'F' group by 1 having count(l.l_partkey) = 0")
def f33(t):
    j = t.orders.where("o_orderstatus = 'F'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(F.count("l_partkey").alias("n")).where("n = 0").select("o_orderkey")


@query("f34_find", "select p_partkey, p_name from part where p_type = 'LARGE' and contains(p_name, 'gear') order by p_partkey limit 20")
def f34(t):
    return t.part.where((F.col("p_type") == "LARGE") & F.contains("p_name", F.lit("gear"))).select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


@query("f35_search", "select p_partkey, p_name from part where contains(lower(p_name), 'ring') and p_type = 'SMALL' order by p_name, p_partkey limit 10")
def f35(t):
    return t.part.where(F.contains(F.lower("p_name"), F.lower(F.lit("Ring"))) & (F.col("p_type") == "SMALL")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(10)


@query("f36_fuzzy_search", "with h as (select 'ring' as term, p_partkey, p_name, row_number() over (order by length(p_name), p_partkey) as n, count(*) over () as total from part where contains(p_name, 'ring')) select term, p_partkey, p_name from h where n <= floor(total * 0.5) union all select 'red ring', p_partkey, p_name from part where p_name = 'red ring'")
def f36(t):
    # no label is just the first term; some are the second, and only these are found
    find = lambda term: M.label_search(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", term).withColumn("term", F.lit(term))
    return find("ring").unionByName(find("red ring"))


@query("f37_constant", "select s_suppkey, s_name, 'math' as subject from supplier")
def f37(t):
    return t.supplier.select("s_suppkey", "s_name", F.lit("math").alias("subject"))


@query("f38_predicates", TRIPLES_SQL + " select distinct p from triples where contains(lower(p), 'source')")
def f38(t):
    return twins.triples(t).select("p").distinct().where(F.contains(F.lower("p"), F.lit("source")))


@query("a1_node_counts", "select coalesce(p_type, 'total') as p_type, count(*) as n from part group by rollup (p_type)")
def a1(t):
    return R.counts_with_total(t.part, "p_type")


@query("a2_class_top", "select p_type, count(*) as n from part group by 1 order by n desc, p_type limit 3")
def a2(t):
    return R.top(t.part, "p_type", 3)


@query("a3_degree_top", "select l_suppkey as src, count(*) as n from (select distinct l_suppkey, l_partkey from lineitem) group by 1 order by n desc, src limit 10")
def a3(t):
    return R.top(twins.related(t), "src", 10)


@query("a4_degrees", "with e as (select distinct l_suppkey as src, l_partkey + 1000000 as dst from lineitem), ends as (select src as node, dst as other, 1 as o from e union all select dst, src, 0 from e) select node, sum(o)::bigint as out_degree, sum(1 - o)::bigint as in_degree, count(*) as degree, count(*) filter (where other in (select p_partkey + 1000000 from part where p_size <= 25)) as concept_degree from ends group by node")
def a4(t):
    e = twins.related(t).withColumn("dst", F.col("dst") + 1000000)
    return R.degrees(e, t.part.where("p_size <= 25").select((F.col("p_partkey") + 1000000).alias("node")))


@query("a6_o3_sampled_objects", TRIPLES_SQL + " select p, o, kind, k from (select *, row_number() over (partition by p, kind order by md5(o), o) as k from (select distinct p, o, case when starts_with(o, 'http') then 'entity' else 'value' end as kind from triples)) where k <= 10")
def a6(t):
    return R.sample_objects(twins.triples(t), T.is_entity(F.col("o"), ["http"]))


@query("a7_domains", "select regexp_extract(url, '://([^/]+)/', 1) as domain, count(*) as n from pages group by 1")
def a7(t):
    return R.counts(t.pages.select(T.uri_parts(F.col("url"))["domain"].alias("domain")), "domain")


@query("a8_prefixes", "with p as (select string_split(replace(p_name, ' ', '/') || '/' || p_type, '/') as a from part), x as (select unnest(range(1, len(a) + 1))::int as depth, a from p), y as (select depth, array_to_string(a[1:depth], '/') as prefix from x) select depth, prefix, count(*) as n, count(*) = 1 as leaf from y group by 1, 2")
def a8(t):
    return R.prefix_counts(t.part.select(F.concat_ws("/", F.translate("p_name", " ", "/"), "p_type").alias("path")))


@query("a9_property_samples", TRIPLES_SQL + " select p, count(*) as n, count(*) filter (where starts_with(o, 'http')) as entities, min(o) as example from triples group by p")
def a9(t):
    return twins.triples(t).groupBy("p").agg(F.count("*").alias("n"), F.count_if(T.is_entity(F.col("o"), ["http"])).alias("entities"), F.min("o").alias("example"))


@query("a10_a13_distributions", "with l as (select 'p_type' as attribute, p_type as value from part union all select 'p_brand', p_brand from part), g as (select attribute, value, count(*) as n from l group by 1, 2) select *, ((20000 * n + sum(n) over (partition by attribute)) // (2 * sum(n) over (partition by attribute)))::double / 100 as percent from g")
def a10(t):
    return R.distributions(t.part, ["p_type", "p_brand"])


@query("a11_completeness", "select count(*) as total, count(*) filter (where quality is null) as missing_quality, count(*) filter (where toxic is null) as missing_toxic from documents left join labels using (doc_id)")
def a11(t):
    return R.completeness(t.documents.join(t.labels, "doc_id", "left"), ["quality", "toxic"])


@query("a12_a18_match_rate", "select coalesce(lang, 'all') as lang, count(*) as total, count(*) filter (where m) as matched, count(*) - count(*) filter (where m) as new, round(count(*) filter (where m)::double / count(*), 4) as rate from (select lang, l.doc_id is not null as m from documents d left join labels l using (doc_id)) group by rollup (lang)")
def a12(t):
    j = t.documents.join(t.labels.select("doc_id", F.lit(True).alias("m")), "doc_id", "left")
    return R.match_rate(j.select("lang", F.coalesce("m", F.lit(False)).alias("matched")), "lang")


@query("a14_a20_roll_up", "select p_name as label, list_sort(list(distinct p_type)) as clss, count(*) as n from part group by 1")
def a14(t):
    return R.roll_up(twins.concepts(t), "label", ["cls"])


@query("a15_merge_chunks", "with f as (select o_orderstatus as stage, o_orderpriority as domain, o_custkey as point, min(o_orderkey) as pos from orders group by 1, 2, 3) select stage, domain, list(point order by pos, point) as points from f group by 1, 2")
def a15(t):
    return R.merge_chunks(t.orders.select(F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("domain"), F.col("o_custkey").alias("point")))


@query("a16_distinct_points", "select distinct o_orderpriority as point from orders order by 1")
def a16(t):
    return t.orders.select(F.col("o_orderpriority").alias("point")).distinct().orderBy("point")


@query("a17_methods", "select event_type as method, count(*) as n, round(avg(value), 6) as avg_value from events group by 1")
def a17(t):
    return t.events.groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("a19_duplicates", "select p_name, count(*) as n from part group by 1 having count(*) > 1")
def a19(t):
    return R.duplicates(t.part, "p_name")


@query("a21_subject_classes", "select n_name as subject, count(distinct c_mktsegment) as classes, count(*) as entities from customer join nation on c_nationkey = n_nationkey group by 1")
def a21(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("subject")).agg(F.count_distinct("c_mktsegment").alias("classes"), F.count("*").alias("entities"))


@query("a22_coverage", "with e as (select l_suppkey as src, l_partkey + 1000000 as dst, l_returnflag as rel_type from lineitem) select c.covered, n.nodes, round(c.covered::double / n.nodes, 6) as coverage from (select count(distinct dst) as covered from e where rel_type = 'R') c, (select count(distinct x) as nodes from (select src as x from e union all select dst from e)) n")
def a22(t):
    return R.coverage(t.lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"), F.col("l_returnflag").alias("rel_type")), ["R"])


@query("a23_a29_shares", "with g as (select case when value >= 20 then 'high' when value >= 5 then 'medium' else 'low' end as band, count(*) as n from events group by 1) select band, n, round(n::double / sum(n) over (), 6) as share from g")
def a23(t):
    return R.confidence_shares(t.events, T.band(F.col("value"), {"high": 20, "medium": 5}, "low"))


@query("a24_subjects_per_property", TRIPLES_SQL + " select p, count(distinct s) as subjects from triples group by p")
def a24(t):
    return twins.triples(t).groupBy("p").agg(F.count_distinct("s").alias("subjects"))


@query("a26_entities_per_subject", "select lang as subject, count(*) as n from documents group by 1")
def a26(t):
    return R.counts(t.documents.select(F.col("lang").alias("subject")), "subject")


@query("a27_ledger", "select o_orderstatus as provider, o_orderpriority as model, count(*) as calls, sum(o_custkey)::bigint as tokens, sum(floor(o_totalprice)::bigint)::bigint as cents, sum(floor(o_totalprice)::bigint) > 1000000 as over from orders group by 1, 2")
def a27(t):
    c = t.orders.select(F.col("o_orderstatus").alias("provider"), F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("tokens"), F.floor("o_totalprice").alias("cents"))
    return R.ledger(c, ["provider", "model"], 1_000_000)


@query("a28_task_status", "select user_id as task, count(*) filter (where event_type = 'purchase') as completed, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type not in ('purchase', 'error')) as pending from events group by 1")
def a28(t):
    k = F.col("event_type")
    return t.events.groupBy(F.col("user_id").alias("task")).agg(F.count_if(k == "purchase").alias("completed"), F.count_if(k == "error").alias("failed"), F.count_if(~k.isin("purchase", "error")).alias("pending"))


@query("a30_cleaning_report", r"select count(*) as total, count(*) filter (where regexp_matches(text, '\s\s')) as extra_space, count(*) filter (where regexp_matches(text, '\s$')) as trailing_space, count(*)::varchar || ' labels checked' as summary from documents")
def a30(t):
    x = F.col("text")
    return t.documents.agg(F.count("*").alias("total"), F.count_if(x.rlike(r"\s{2,}")).alias("extra_space"), F.count_if(x.rlike(r"\s$")).alias("trailing_space"), F.format_string("%d labels checked", F.count("*")).alias("summary"))


@query("a31_g10_tree", "select n_regionkey as parent, list_sort(list(distinct n_nationkey)) as children from nation group by 1")
def a31(t):
    from ..operators import graph as G

    return G.children_map(t.nation.select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")))


@query("a32_folds", "select p_partkey, p_type, ((row_number() over (partition by p_type order by md5(p_partkey::varchar), p_partkey) - 1) % 5)::bigint as fold from part")
def a32(t):
    return R.stratified_folds(t.part.select("p_partkey", "p_type"), "p_type", "p_partkey", 5)


_A33 = "with c as (select p_partkey as uri, p_name as label from part), twice as (select * from c where uri < 50), other as (select * from c where uri >= 50 and uri < 100), t(which, side, uri, label) as (select 'same', 0, * from c union all select 'same', 1, * from c union all select 'changed', 0, * from c union all select 'changed', 1, uri, case when uri = 0 then label || '!' else label end from c union all select 'fewer', 0, * from c union all select 'fewer', 1, * from c where uri > 0 union all select 'repeats', 0, * from (select * from c union all select * from twice union all select * from twice) union all select 'repeats', 1, * from (select * from c union all select * from other union all select * from other))"


@query("a33_freshness", _A33 + ", n as (select which, uri, label, count(*) filter (where side = 0) as a, count(*) filter (where side = 1) as b from t group by all) select which, bool_and(a = b) as fresh, sum(a)::bigint as stored_rows, sum(b)::bigint as now_rows from n group by 1")
def a33(t):
    c = twins.concepts(t).select("uri", "label")
    changed = c.withColumn("label", F.when(F.col("uri") == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label")))
    twice, other = c.where("uri < 50"), c.where("uri >= 50 and uri < 100")
    of = lambda name, stored, now: R.freshness(stored, now).select(F.lit(name).alias("which"), "fresh", "stored_rows", "now_rows")
    # rows that are there three times, others in the one table than in the other: an xor of digests would not see it
    repeats = of("repeats", c.union(twice).union(twice), c.union(other).union(other))
    return of("same", c, c.repartition(7)).unionByName(of("changed", c, changed)).unionByName(of("fewer", c, c.where("uri > 0"))).unionByName(repeats)


@query("w1_running_number", "select p_partkey, row_number() over (order by p_name, p_partkey) as n from part")
def w1(t):
    return E.running_number(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"]).select("p_partkey", F.col("n").cast("long"))


@query("w2_outline", "with h as (select conv_id, turn, text, case when role = 'user' then 'chapter' else 'other' end as kind from conversations), c as (select *, sum((kind = 'chapter')::int) over (partition by conv_id order by turn, text rows unbounded preceding)::bigint as chapter from h) select conv_id, turn, chapter, sum((kind <> 'chapter')::int) over (partition by conv_id, chapter order by turn, text rows unbounded preceding)::bigint as section from c")
def w2(t):
    h = t.conversations.select("conv_id", "turn", "text", F.when(F.col("role") == "user", "chapter").otherwise("other").alias("kind")).withColumn("place", F.struct("turn", "text"))
    return E.outline(h, "conv_id", "place", "kind", "text").select("conv_id", "turn", "chapter", "section")


@query("w5_continue_ids", "with old as (select distinct p_type as section, p_name as label from part where p_size > 25), o as (select *, row_number() over (order by section, label) as seq from old), fresh as (select distinct p_type as section, p_name as label from part except select section, label from old) select section, label, row_number() over (order by section, label) + (select max(seq) from o) as seq from fresh")
def w5(t):
    rows = t.part.select(F.col("p_type").alias("section"), F.col("p_name").alias("label"), "p_size")
    old = E.running_number(rows.where("p_size > 25").select("section", "label").distinct(), ["section", "label"]).withColumnRenamed("n", "seq")
    return E.continue_ids(old, rows).withColumn("seq", F.col("seq").cast("long"))


@query("w7_stage_ranges", "with m as (select o_custkey as book, o_orderpriority as stage, min(o_orderkey) as first from orders group by 1, 2) select *, coalesce(lead(first) over (partition by book order by first, stage) - 1, 10000000) as last from m")
def w7(t):
    return E.stage_ranges(t.orders.select(F.col("o_custkey").alias("book"), F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("page")), 10_000_000)


@query("w8_page_chunks", "with c as (select conv_id as doc, turn as page, text, (row_number() over (partition by conv_id order by turn, text) - 1) // 3 as chunk from conversations) select doc, chunk, min(page) as first, max(page) as last, md5(string_agg(text, chr(10) order by page, text)) as digest from c group by 1, 2")
def w8(t):
    c = E.page_chunks(t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"), 3)
    return c.select("doc", "chunk", "first", "last", F.md5("text").alias("digest"))


@query("w9_pack_paragraphs", r"""with recursive t as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents where text is not null),
p as (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as p, unnest(range(len(string_split(text, chr(10) || chr(10))))) as i from t where length(text) > 8000),
r(doc_id, i, part, used) as (select doc_id, 0::bigint, 0::bigint, length(p) + 2 from p where i = 0 union all select r.doc_id, p.i, case when used + length(p) + 2 <= 8000 then part else part + 1 end, case when used + length(p) + 2 <= 8000 then used + length(p) + 2 else length(p) + 2 end from r join p on p.doc_id = r.doc_id and p.i = r.i + 1),
x as (select doc_id, part, regexp_replace(string_agg(p, chr(10) || chr(10) order by i), '^\s+|\s+$', '', 'g') as text from r join p using (doc_id, i) group by 1, 2 union all select doc_id, 0, text from t where length(text) <= 8000)
select doc_id, part::int as part, length(text)::int as n_chars, md5(text) as digest from x""")
def w9(t):
    # lines stand for paragraphs
    text = F.regexp_replace("text", "\n", "\n\n")
    return t.documents.select("doc_id", F.posexplode(E.pack_paragraphs(text)).alias("part", "text")).select("doc_id", "part", F.char_length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("w10_batches", "select p_partkey, (row_number() over (order by p_partkey) - 1) // 50 as batch from part")
def w10(t):
    return E.batches(t.part.select("p_partkey"), ["p_partkey"], 50).select("p_partkey", "batch")


@query("o1_ordered_sample", "select p_name, p_size, p_partkey from part order by p_name, p_size, p_partkey limit 25")
def o1(t):
    return t.part.select("p_name", "p_size", "p_partkey").orderBy("p_name", "p_size", "p_partkey").limit(25)


@query("o4_confident_sample", "select event_id, value from events order by value desc, event_id limit 20")
def o4(t):
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)
