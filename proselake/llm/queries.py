"""The training-data queries that __spark_entry__.py registers, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm import block_max, compact_windows, forest, hash_index, language_id, packing, part_codes, pfair, simhash, site_style, suffix_array, url_tree, word_table
from proselake.llm.common import table

#: Target weights of the mixed stream; other sources weigh the share of all that they hold.
TARGETS = {f"src{k}": 0.1 if k < 4 else 0.0375 for k in range(20)}


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector among all others."""
    return hash_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents: doc_id, fingerprint in hex, component_id, n_same (rows with that fingerprint)."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id", "n_same")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, a row for each piece."""
    placed = packing.packed_documents(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that nearly repeat across documents, a row for each document."""
    return compact_windows.near_duplicates(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")


def op6_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, or else by its template's share of good pages."""
    found = url_tree.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op7_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one stream that mixes their sources to TARGETS, by characters, as long as each lasts."""
    docs = table(spark, sf_dir, "documents")
    return pfair.schedule(docs, TARGETS).select("doc_id", "source", "block", "last_block", "release", "deadline", "slot", "nth")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that start in an earlier one."""
    return suffix_array.digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal labels, a row for each vector."""
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return site_style.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors over codebooks of 16 parts and 64 entries, moved twice."""
    found = part_codes.compressed(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op12_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by way of its distinct words, and decoded again."""
    found = word_table.round_trip(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    found = block_max.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").cast("long").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_multi_index_hashing": op1_multi_index_hashing,
        "op2_simhash": op2_simhash,
        "op3_packing": op3_packing,
        "op4_language_id": op4_language_id,
        "op5_compact_windows": op5_compact_windows,
        "op6_url_tree": op6_url_tree,
        "op7_pfair": op7_pfair,
        "op8_suffix_array": op8_suffix_array,
        "op9_projection_forest": op9_projection_forest,
        "op10_site_style": op10_site_style,
        "op11_part_codes": op11_part_codes,
        "op12_word_table": op12_word_table,
        "op13_block_max": op13_block_max,
    }


#: Every window of 50 bytes, its smallest document, and what the windows of smaller documents cover.
SUFFIX_ARRAY_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h, octet_length(encode(coalesce(text,''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2*i+1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, n-49))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE f.low < w.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
sp AS (SELECT doc_id, min(i) AS s, max(i)+50 AS e FROM k GROUP BY doc_id, span),
b AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM sp),
j AS (SELECT b.doc_id, sum(e-s) AS removed, count(*) AS spans, max(e) AS last, string_agg(substr(d.h, 2*before+1, 2*(s-before)), '' ORDER BY s) AS kept FROM b JOIN d USING (doc_id) GROUP BY b.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
sha256(unhex(coalesce(kept, '') || substr(h, 2*coalesce(last, 0)+1))) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)"""

FOREST_SQL = """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS root FROM e UNION SELECT p.b, reach.root FROM reach JOIN p ON p.a = reach.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node), l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.node = e.vec_id LEFT JOIN l ON l.a = e.vec_id"""


#: Pages of one article whose blocks are p and h1: all that these tables hold. Blocks are parted at their tags.
SITE_STYLE_SQL = r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(a, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""


def _url_tree_sql() -> str:
    """Templates by the segments' form alone: no place of these tables has more children than are kept apart."""
    fits = []
    for rule, verdict in sorted(url_tree.RULES, key=lambda r: (-len(r[0]), r[0])):
        host, _, begin = rule.partition("/")
        fits.append(f"WHEN (host='{host}' OR ends_with(host,'.{host}')) AND starts_with(path,'/{begin}') THEN ['{rule}','{verdict}']")
    ending = r"regexp_extract(s,'(\.[A-Za-z][A-Za-z0-9]{0,4})$',1)"
    kind = rf"""CASE WHEN regexp_matches(s,'^[0-9]+(\.[A-Za-z0-9]{{1,5}})?$') THEN '{{number}}'||{ending} WHEN regexp_matches(s,'^[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?$') THEN '{{date}}'
WHEN regexp_matches(s,'[0-9]') AND regexp_matches(s,'^[0-9a-fA-F-]{{8,}}$') THEN '{{hex}}' WHEN regexp_matches(s,'[0-9].*[0-9].*[0-9]') AND length(s)>=8 THEN '{{mixed}}' ELSE s END"""
    both = "((acc[-1].good+x[1].good)/(acc[-1].labelled+x[1].labelled))"
    alike = f"abs(x[1].good/x[1].labelled-acc[-1].good/acc[-1].labelled)<=1.96*sqrt({both}*(1-{both})*(1/acc[-1].labelled+1/x[1].labelled))"
    merged = "list_append(acc[:len(acc)-1], struct_pack(good := acc[-1].good+x[1].good, labelled := acc[-1].labelled+x[1].labelled, ts := list_concat(acc[-1].ts, x[1].ts)))"
    return rf"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url,'(?s)^.*?://([^/?#]*)',1),''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url,'(?s)^.*?://[^/?#]*([^?#]*)',1),'') AS path FROM pages),
v AS (SELECT *, '/'||array_to_string(list_transform(list_filter(string_split(path,'/'), lambda s: s<>''), lambda s: {kind}),'/') AS template, CASE {' '.join(fits)} END AS fit FROM u),
k AS (SELECT doc_id, sum(quality) AS good, count(*) AS labelled FROM labels WHERE quality IN (0,1) GROUP BY doc_id),
o AS (SELECT host, template, regexp_replace(template,'/[^/]*$','') AS parent, coalesce(sum(good),0)::DOUBLE AS good, coalesce(sum(labelled),0)::DOUBLE AS labelled FROM v LEFT JOIN k ON k.doc_id=v.page_id GROUP BY host, template),
s AS (SELECT host, parent, list(struct_pack(good := good, labelled := labelled, ts := [template]) ORDER BY good/labelled, template) AS sib FROM o WHERE labelled>0 GROUP BY host, parent),
m AS (SELECT host, unnest(list_reduce(list_transform(sib, lambda x: [x]), lambda acc, x: CASE WHEN {alike} THEN {merged} ELSE list_concat(acc, x) END)) AS g FROM s),
n AS (SELECT host, unnest(g.ts) AS template, g.good AS m_good, g.labelled AS m_labelled FROM m),
p AS (SELECT host, parent, sum(good) AS b_good, sum(labelled) AS b_labelled FROM o GROUP BY host, parent), h AS (SELECT host, sum(good) AS h_good, sum(labelled) AS h_labelled FROM o GROUP BY host), e AS (SELECT sum(good)/sum(labelled) AS on_all FROM o),
r AS (SELECT host, template, on_all, coalesce(m_good,0) AS good, coalesce(m_labelled,0) AS n, (b_good+20*(h_good+20*on_all)/(h_labelled+20))/(b_labelled+20) AS prior FROM o JOIN p USING (host, parent) JOIN h USING (host) LEFT JOIN n USING (host, template), e),
w AS (SELECT host, template, (good+20*prior)/(n+20) AS purity, CASE WHEN n>0 THEN (good/n+1.96*1.96/(2*n)+1.96*sqrt(good/n*(1-good/n)/n+1.96*1.96/(4*n*n)))/(1+1.96*1.96/n)<on_all ELSE false END AS worse FROM r)
SELECT page_id, host, path, fit[1] AS rule, coalesce(fit[2], CASE WHEN purity<0.5 OR worse THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity,6) AS purity FROM v JOIN w USING (host, template)"""


URL_TREE_SQL = _url_tree_sql()


def _pfair_sql() -> str:
    """Earliest deadline first, a slot a step: each source's next block with its window in the phase, which ends with a source's last block."""
    shares = pfair.exact_shares({s: Fraction(str(w)) for s, w in TARGETS.items()})
    values = ", ".join(f"('{s}', {n})" for s, n in shares.items())
    release, due = "x.i*whole//x.share", "((x.i+1)*whole+x.share-1)//x.share"
    step = "CASE WHEN x.s=pick.s THEN struct_pack(s := x.s, share := x.share, n := x.n, done := x.done+1, i := x.i+1) ELSE x END"
    fresh = "struct_pack(s := x.s, share := x.share, n := x.n, done := x.done, i := CAST(0 AS BIGINT))"
    return f"""WITH RECURSIVE w AS (SELECT * FROM (VALUES {values}) v(source, share)),
d AS (SELECT doc_id, source, coalesce(source,'') AS s, coalesce(length(text),0)+1 AS size, CAST('0x'||substr(md5(coalesce(CAST(doc_id AS VARCHAR),'')),1,15) AS BIGINT) AS h FROM documents),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY s ORDER BY h, doc_id) AS BIGINT) AS own FROM d),
b AS (SELECT s, (max(own)+65535)//65536 AS n FROM o GROUP BY s),
st AS (SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS begin, list(struct_pack(s := s, share := CAST(share AS BIGINT), n := CAST(n AS BIGINT), done := CAST(0 AS BIGINT), i := CAST(0 AS BIGINT)) ORDER BY s) AS q, CAST(NULL AS VARCHAR) AS s, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS release, CAST(0 AS BIGINT) AS deadline FROM b JOIN w ON w.source=b.s
UNION ALL SELECT slot, CASE WHEN ends THEN slot+1 ELSE begin END, CASE WHEN ends THEN list_transform(next, lambda x: {fresh}) ELSE next END, pick.s, pick.block, begin+pick.release, begin+pick.due
FROM (SELECT *, list_transform(q, lambda x: {step}) AS next, pick.block+1=pick.n AS ends FROM (SELECT *, list_sort(list_transform(list_filter(q, lambda x: x.done<x.n AND {release}<=slot-begin), lambda x: struct_pack(due := {due}, s := x.s, block := x.done, release := {release}, n := x.n)))[1] AS pick
 FROM (SELECT slot+1 AS slot, begin, q, list_sum(list_transform(list_filter(q, lambda x: x.done<x.n), lambda x: x.share)) AS whole FROM st WHERE len(list_filter(q, lambda x: x.done<x.n))>0))))
SELECT doc_id, o.source, block, (own-1)//65536 AS last_block, CAST(release AS BIGINT) AS release, CAST(deadline AS BIGINT) AS deadline, slot, own-size AS nth FROM o JOIN st ON st.s=o.s AND st.block=(own-size)//65536 AND st.slot>=0"""


PFAIR_SQL = _pfair_sql()


def _simhash_sql(seed: int = 42) -> str:
    """XXH64 of every shingle in 128-bit arithmetic, majorities bit by bit, and fingerprints compared two by two."""
    m = 1 << 64
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    big = lambda x: f"{x}::UHUGEINT"
    whole = big(m)

    def rotated(x: str, r: int) -> str:
        return f"((({x})*{big(1 << r)})%{whole}+({x})//{big(1 << (64 - r))})"

    def times(x: str, p: int) -> str:
        return f"(({x})*{big(p)})%{whole}"

    def added(x: str, y: str) -> str:
        return f"(({x})+({y}))%{whole}"

    def lane(v: str, k: str) -> str:
        return f"({times(rotated(f'({added(v, times(k, p2))})', 31), p1)})"

    def number(at: str, n: int) -> str:  # little-endian bytes from byte `at`
        return "CAST('0x'||" + "||".join(f"substr(x,2*({at})+{2 * k + 1},2)" for k in reversed(range(n))) + " AS UHUGEINT)"

    zero = big(0)
    start = [(seed + p1 + p2) % m, (seed + p2) % m, seed, (seed - p1) % m]
    first = "struct_pack(" + ", ".join(f"a{k} := {big(v)}" for k, v in enumerate(start)) + ")"
    stripe = "struct_pack(" + ", ".join(f"a{k} := {number(f'32*q+{8 * k}', 8)}" for k in range(4)) + ")"
    lanes = "struct_pack(" + ", ".join(f"a{k} := {lane(f'v.a{k}', f'z.a{k}')}" for k in range(4)) + ")"
    mixed = added(added(rotated("v.a0", 1), rotated("v.a1", 7)), added(rotated("v.a2", 12), rotated("v.a3", 18)))
    for k in range(4):
        mixed = added(times(f"xor({mixed}, {lane(zero, f'v.a{k}')})", p1), big(p4))
    eight = added(times(rotated(f"xor(h, {lane(zero, 'z')})", 27), p1), big(p4))
    four = added(times(rotated(f"xor(h, {times('z', p1)})", 23), p2), big(p3))
    one = times(rotated(f"xor(h, {times('z', p5)})", 11), p1)
    words = r"list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\x20\x09-\x0D]+'), lambda w: w<>'')"
    bits = ", ".join(f"CASE WHEN 2*sum((h{'i' if k >= 32 else 'o'}>>{k % 32})&1)>count(*) THEN {1 << (k % 32)} ELSE 0 END AS b{k}" for k in range(64))
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, {words} AS t FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(t)=0 THEN [] WHEN len(t)<3 THEN [array_to_string(t,' ')] ELSE list_transform(range(1,len(t)-1), lambda k: t[k]||' '||t[k+1]||' '||t[k+2]) END) AS sh FROM w),
x AS (SELECT sh, lower(hex(encode(sh))) AS x, octet_length(encode(sh)) AS n FROM (SELECT DISTINCT sh FROM s)),
v AS (SELECT *, CASE WHEN n>=32 THEN list_reduce(list_prepend({first}, list_transform(range(0, n//32), lambda q: {stripe})), lambda v, z: {lanes}) END AS v, n//32*32 AS done FROM x),
h1 AS (SELECT sh, x, n, done, {added(f"CASE WHEN n>=32 THEN {mixed} ELSE {big((seed + p5) % m)} END", "n::UHUGEINT")} AS h FROM v),
h2 AS (SELECT sh, x, n, done+(n-done)//8*8 AS done, list_reduce(list_prepend(h, list_transform(range(0, (n-done)//8), lambda q: {number('done+8*q', 8)})), lambda h, z: {eight}) AS h FROM h1),
h3 AS (SELECT sh, x, n, done+(n-done)//4*4 AS done, list_reduce(list_prepend(h, list_transform(range(0, (n-done)//4), lambda q: {number('done+4*q', 4)})), lambda h, z: {four}) AS h FROM h2),
h4 AS (SELECT sh, list_reduce(list_prepend(h, list_transform(range(done, n), lambda q: {number('q', 1)})), lambda h, z: {one}) AS h FROM h3),
h5 AS (SELECT sh, {times(f"xor(h, h//{big(1 << 33)})", p2)} AS h FROM h4), h6 AS (SELECT sh, {times(f"xor(h, h//{big(1 << 29)})", p3)} AS h FROM h5), h7 AS (SELECT sh, xor(h, h//{big(1 << 32)}) AS h FROM h6),
hh AS (SELECT sh, CAST(h//{big(1 << 32)} AS BIGINT) AS hi, CAST(h%{big(1 << 32)} AS BIGINT) AS ho FROM h7),
b AS (SELECT doc_id, {bits} FROM s JOIN hh USING (sh) GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce({'+'.join(f'b{k}' for k in range(32, 64))},0)::BIGINT AS hi, coalesce({'+'.join(f'b{k}' for k in range(32))},0)::BIGINT AS lo FROM documents d LEFT JOIN b USING (doc_id)),
g AS (SELECT hi, lo, count(*) AS n_same, min(doc_id) AS low FROM f GROUP BY hi, lo),
e AS (SELECT a.hi, a.lo, b.low FROM g a JOIN g b ON bit_count(xor(a.hi,b.hi))+bit_count(xor(a.lo,b.lo))<=2),
r AS (SELECT low AS node, low AS root FROM g UNION SELECT e.low, r.root FROM r JOIN g ON g.low=r.node JOIN e ON e.hi=g.hi AND e.lo=g.lo),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, printf('%08x%08x', hi, lo) AS fingerprint, component_id, n_same FROM f JOIN g USING (hi, lo) JOIN c ON c.node=g.low"""


SIMHASH_SQL = _simhash_sql()


#: All pairs of a query and a candidate. The index gives the same where it probes every code, as it does on fewer than 512 vectors.
HASH_INDEX_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND len(list_filter(embedding, lambda x: x<>0))>0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v)+1), lambda k: (c.v[k]-q.v[k])*(c.v[k]-q.v[k])), lambda a, b: a+b)) AS score FROM e q JOIN e c ON c.vec_id<>q.vec_id WHERE q.vec_id%100=0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM d WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w<=10"""


def _part_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry; the least of distance * entries + index is the nearest of lowest index."""
    far = "list_sum(list_transform(range(1, len(p.c)+1), lambda k: (p.c[k]-b.c[k])*(p.c[k]-b.c[k])))"
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256*x) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0)",
        f"p AS (SELECT vec_id, label, part, v[part*len(v)//{parts}+1:(part+1)*len(v)//{parts}] AS c FROM v, (SELECT unnest(range(0, {parts})) AS part))",
        f"b0 AS (SELECT part, rn-1 AS entry, c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM v) USING (vec_id) WHERE rn<={entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT vec_id, part, min({far}*{entries}+entry) AS best FROM p JOIN b{k} b USING (part) GROUP BY vec_id, part)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT part, entry, list(m ORDER BY d) AS c FROM (SELECT part, entry, d, CAST(floor(sum(x)/count(*)) AS BIGINT) AS m FROM (SELECT part, CAST(best%{entries} AS BIGINT) AS entry, unnest(c) AS x, generate_subscripts(c,1) AS d FROM a{k} JOIN p USING (vec_id, part)) GROUP BY ALL) GROUP BY part, entry)")
            steps.append(f"b{k + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    return f"""WITH {', '.join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', CAST(best%{entries} AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(best//{entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM e JOIN v USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM e JOIN v USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM v.label, h"""


PART_CODES_SQL = _part_codes_sql()

BLOCK_MAX_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
a AS (SELECT count(*) AS n_docs, sum(len(t)) AS length FROM d WHERE len(t)>0),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000*ln((2*n_docs+2)::DOUBLE/(2*count(*)+1))) AS BIGINT) AS w FROM p, a GROUP BY term, n_docs),
m AS (SELECT doc_id, CAST(50+(50*len(t)*n_docs)//length AS BIGINT) AS m FROM d, a WHERE len(t)>0),
s AS (SELECT item_id, doc_id, CAST(sum(w*((1000000000*tf)//(1000*tf+20*m))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER r AS INT) AS rank, doc_id, score FROM s WHERE score>0 WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r<=50"""


def oracle_sql() -> dict[str, str]:
    return {"op1_multi_index_hashing": HASH_INDEX_SQL, "op2_simhash": SIMHASH_SQL, "op6_url_tree": URL_TREE_SQL, "op7_pfair": PFAIR_SQL, "op8_suffix_array": SUFFIX_ARRAY_SQL, "op9_projection_forest": FOREST_SQL, "op10_site_style": SITE_STYLE_SQL, "op11_part_codes": PART_CODES_SQL, "op13_block_max": BLOCK_MAX_SQL}
