"""DuckDB SQL of the order-dependent text operators: written apart from them, with lists, regular expressions and recursion."""

from __future__ import annotations

from proselake.functions import lexicon
from proselake.operators import grammar
from proselake.plans.registry import exploded_, narration_, paragraphs_, sentences_, tokens_, words

STOP = words(lexicon.STOPWORDS)
_TRIM = r"regexp_replace({x},'^\s+|\s+$','','g')"


def among(items) -> str:
    return "(" + ",".join("'" + w.replace("'", "''") + "'" for w in sorted(items)) + ")"


# ---- contrasts: a letter for each token, shapes as regular expressions without look-around ----


def tag_(w: str) -> str:
    low = f"lower({w})"
    ends = lambda xs: "(" + " OR ".join(f"ends_with({low},'{x}')" for x in xs) + ")"
    return f"""CASE WHEN {low} IN {among(grammar.BE | grammar.DO)} THEN 'VERB' WHEN {low} IN ('a','an','the') THEN 'DET' WHEN {low}='not' OR ends_with({low},'n''t') THEN 'NEG'
WHEN {low} IN {among(grammar.CONJUNCTIONS)} THEN 'CONJ' WHEN {low} IN {among(grammar.PRONOUNS)} THEN 'PRON' WHEN ends_with({low},'ly') THEN 'ADV'
WHEN {ends(('tion', 'ment', 'ness', 'ity', 'ure'))} THEN 'NOUN' WHEN {ends(('ing', 'ed'))} THEN 'VERB' WHEN ends_with({low},'s') AND NOT {ends(('ss', 'us', 'is', 'as', 'os'))} THEN 'VERB'
WHEN {ends(grammar.ADJECTIVE)} THEN 'ADJ' WHEN {low} IN {among(grammar.VERBS)} THEN 'VERB' ELSE 'NOUN' END"""


def letter_(w: str) -> str:
    low = f"lower({w})"
    return f"""CASE WHEN {low}='not' THEN 'n' WHEN {low} IN ('only','to') THEN 'x' WHEN {w} IN (',',';','—','–') THEN 'c' WHEN {w}='but' THEN 'u' WHEN {low}='but' THEN 'U'
WHEN {low} IN {among(grammar.CONJUNCTIONS)} THEN 'j' WHEN {low} IN {among(grammar.NEGATED_BE)} THEN 'I' WHEN {low} IN {among(grammar.NEGATED_DO)} THEN 'N' WHEN {low} IN ('be','been','being') THEN 'b'
WHEN {low} IN {among(grammar.BE)} THEN 'B' WHEN {low} IN {among(grammar.DO)} THEN 'D' WHEN {low} IN {among(grammar.HAVE)} THEN 'H' WHEN ({tag_(w)})='VERB' THEN 'v' ELSE 'w' END"""


_HOSTS = "|".join(sorted(grammar.HOSTS))
_SPLIT = rf"""flatten(list_transform(regexp_extract_all(sentence,'[\p{{L}}\p{{N}}_]+(?:''[\p{{L}}\p{{N}}_]+)?|[^\s\p{{Z}}\p{{Cc}}\p{{L}}\p{{N}}_]'),
lambda w: CASE WHEN regexp_matches(lower(w),'^({_HOSTS})(''s|''re|''m)$') THEN [regexp_extract(w,'^(.+)''(.+)$',1), lower(regexp_extract(w,'(''[^'']+)$',1))] ELSE [w] END))"""
_MARKS = "('.','!','?',',',';',':')"


def _bare(x: str) -> str:
    """Without the marks at the end."""
    return f"{x}[1:len({x})+1-coalesce(list_position(list_transform(list_reverse({x}), lambda w: w NOT IN {_MARKS}), true), len({x})+1)]"


def _is_phrase(x: str, y: str, objects: str) -> str:
    signals = among(grammar.SIGNALS)
    starts = f"(len({y})>0 AND lower({y}[1]) IN {signals} AND lower({y}[1]) NOT IN {objects})"
    return f"len(list_filter({x}, lambda w: lower(w) IN {signals}))=0 AND len(list_filter({x}, lambda w: lower(w) NOT IN ('a','an','the',',')))<=5 AND NOT {starts}"


def contrasts_(source: str, unit: str = "doc_id") -> str:
    """WITH-clauses that end in `contrasts` (unit, i, sentence, x_template, y_template, is_parallel) over the text of `source`."""
    be, do = r"^(.[^cu]*)[cu]([^Bb]*)[Bb](.*)$", r"^(.[^cu]*)[cu]([^BbDHvuUj]*)(H[BbDHv]|[BbDHv])(.*)$"
    pointing, personal = among(grammar.POINTING), among(grammar.PERSONAL)
    tags = lambda x: f"array_to_string(list_transform({x}, lambda w: {tag_('w')}),' ')"
    return f"""cs AS ({exploded_(unit, sentences_('text'), source)}),
cw AS (SELECT {unit}, i, sentence, {_SPLIT} AS t FROM cs WHERE regexp_matches(sentence,'(?i)not|n''t') AND NOT regexp_matches(sentence,'\\?\\s*$')),
cl AS (SELECT *, array_to_string(list_transform(t, lambda w: {letter_('w')}),'') AS l FROM cw WHERE len(t)>=4),
ca AS (SELECT *, length(regexp_extract(l,'^([^n]*n)[^x][^uU]*[uU].*$',1)) AS n1, length(regexp_extract(l,'^[^n]*n([^x][^uU]*)[uU].*$',1)) AS m1,
 regexp_extract(l,'^(.*?)(I|Bn)',1) AS pre2, regexp_extract(l,'^(.*?)(I|Bn)',2) AS neg2, regexp_extract(l,'^(.*?)(N|[DH]n)',1) AS pre3, regexp_extract(l,'^(.*?)(N|[DH]n)',2) AS neg3 FROM cl),
cb AS (SELECT *, length(pre2)+length(neg2) AS n2, substr(l, length(pre2)+length(neg2)+1) AS r2, length(pre3)+length(neg3) AS n3, substr(l, length(pre3)+length(neg3)+1) AS r3 FROM ca),
cc AS (SELECT *, length(regexp_extract(r2,'{be}',1)) AS m2, length(regexp_extract(r2,'{be}',2)) AS g2, length(regexp_extract(r3,'{do}',1)) AS m3, length(regexp_extract(r3,'{do}',2)) AS g3,
 length(regexp_extract(r3,'{do}',3)) AS v3 FROM cb),
cd AS (SELECT *, {_bare('t[n1+1:n1+m1]')} AS x1, {_bare('t[n1+m1+2:]')} AS y1, {_bare('t[n2+1:n2+m2]')} AS x2, {_bare('t[n2+m2+g2+3:]')} AS y2, {_bare('t[n3+1:n3+m3]')} AS x3, {_bare('t[n3+m3+g3+v3+2:]')} AS y3,
 t[n2+m2+g2+1] AS own2, lower(t[length(pre2)]) AS was2, t[n3+m3+g3+1] AS own3, lower(t[length(pre3)]) AS was3 FROM cc),
ce AS (SELECT *, n1>0 AND len(x1)>0 AND len(y1)>0 AND {_is_phrase('x1', 'y1', "('this','that')")} AS ok1,
 neg2<>'' AND m2>0 AND len(x2)>0 AND (g2=0 OR coalesce(lower(own2)=was2 AND length(pre2)>0, false) OR (lower(own2) IN {pointing} AND (length(pre2)=0 OR was2 NOT IN {personal}))) AS ok2,
 neg3<>'' AND m3>0 AND len(x3)>0 AND {_is_phrase('x3', 'y3', pointing)} AND (g3=0 OR coalesce(lower(own3)=was3 AND length(pre3)>0, false) OR own3 IN {pointing}) AS ok3 FROM cd),
cf AS (SELECT {unit}, i, sentence, CASE WHEN ok1 THEN x1 WHEN ok2 THEN x2 ELSE x3 END AS x, CASE WHEN ok1 THEN y1 WHEN ok2 THEN y2 ELSE y3 END AS y FROM ce WHERE ok1 OR ok2 OR ok3),
cg AS (SELECT {unit}, i, sentence, {tags('x')} AS x_template, {tags('y')} AS y_template FROM cf),
contrasts AS (SELECT *, x_template=y_template AS is_parallel FROM cg)"""


# ---- templates: heads of clusters, found in turns ----


def templates_(source: str, unit: str, most: int, flag: int, similarity: float) -> str:
    """WITH RECURSIVE-clauses that end in `clusters` (unit, cluster, n, template) and `told` (unit, total).

    A template joins the first cluster whose first member is alike: equal, beginning alike, or with enough words in common. In
    each turn a template whose earlier mates are all no heads becomes one; one with a head among them becomes none.
    """
    begins = f"(least(len(x),len(y))>={max(1, most - 1)} AND x[1:least(len(x),len(y))]=y[1:least(len(x),len(y))])"
    return f"""ts AS ({exploded_(unit, narration_('text'), source)}),
told AS (SELECT {unit}, count(*) AS total FROM ts GROUP BY {unit}),
tt AS (SELECT {unit}, i, {tokens_('sentence')}[1:{most}] AS t FROM ts),
tn AS (SELECT {unit}, row_number() OVER (PARTITION BY {unit} ORDER BY i) AS k, t FROM tt WHERE len(t)>=3),
tf AS (SELECT {unit}, t, array_to_string(t,' ') AS key, min(k) AS f FROM tn GROUP BY {unit}, t),
td AS (SELECT {unit}, t, key, f, unnest(list_distinct(t)) AS w, len(list_distinct(t)) AS d FROM tf),
tp AS (SELECT {unit}, any_value(a.t) AS x, any_value(b.t) AS y, a.key AS kx, b.key AS ky, count(*) AS common, any_value(a.d) AS dx, any_value(b.d) AS dy FROM td a JOIN td b USING ({unit}, w) WHERE b.f<a.f GROUP BY {unit}, a.key, b.key),
mates AS (SELECT {unit}, kx, ky FROM tp WHERE {begins} OR common/(dx+dy-common)>={similarity}),
st AS (SELECT {unit}, key, f, CASE WHEN EXISTS (SELECT 1 FROM mates m WHERE m.{unit}=tf.{unit} AND m.kx=tf.key) THEN 0 ELSE 1 END AS state, 0 AS turn FROM tf
UNION ALL SELECT s.{unit}, s.key, s.f, CASE WHEN s.state<>0 THEN s.state WHEN o.heads>0 THEN 2 WHEN o.unknown=0 THEN 1 ELSE 0 END, s.turn+1
FROM st s LEFT JOIN (SELECT m.{unit}, m.kx, count(*) FILTER (WHERE q.state=1) AS heads, count(*) FILTER (WHERE q.state=0) AS unknown FROM mates m JOIN st q ON q.{unit}=m.{unit} AND q.key=m.ky GROUP BY m.{unit}, m.kx) o ON o.{unit}=s.{unit} AND o.kx=s.key
WHERE (SELECT bool_or(state=0) FROM st)),
sf AS (SELECT {unit}, key, f, state=1 AS is_head FROM st QUALIFY row_number() OVER (PARTITION BY {unit}, key ORDER BY turn DESC)=1),
homes AS (SELECT a.{unit}, a.key, CASE WHEN a.is_head THEN a.f ELSE min(b.f) END AS cluster FROM sf a LEFT JOIN mates m ON m.{unit}=a.{unit} AND m.kx=a.key LEFT JOIN sf b ON b.{unit}=a.{unit} AND b.key=m.ky AND b.is_head GROUP BY a.{unit}, a.key, a.is_head, a.f),
placed AS (SELECT n.{unit}, h.cluster, n.k, h.key AS template FROM tn n JOIN homes h ON h.{unit}=n.{unit} AND h.key=array_to_string(n.t,' ')),
counted AS (SELECT {unit}, cluster, template, count(*) AS c, min(k) AS first FROM placed GROUP BY ALL),
clusters AS (SELECT {unit}, cluster, CAST(sum(c) AS BIGINT) AS n, arg_max(template, c*1000000000000 - length(template)*10000000 - first) AS template FROM counted GROUP BY ALL)"""


# ---- spans: dialogue, emphasis and what stands between ----

SPAN = r"""["“‘][^"”’]*["”’]|\*[^\s*][^*\n]*\*|_[^\s_][^_\n]*_"""


def spans_(source: str, unit: str = "doc_id") -> str:
    """WITH-clauses that end in `spans` (unit, paragraph, k, type, body): the block spans of every paragraph in order."""
    cut = f"regexp_replace(p,'({SPAN})',chr(1)||'\\1'||chr(1),'g')"
    kind = """CASE WHEN regexp_matches(body,'^["“‘]') AND k%2=0 THEN 'SPEECH' WHEN k%2=0 THEN 'EMPHASIS' ELSE 'NARRATION' END"""
    return f"""sp AS (SELECT {unit}, unnest(ps) AS p, generate_subscripts(ps,1)-1 AS paragraph FROM (SELECT {unit}, {paragraphs_('text')} AS ps FROM {source})),
sq AS (SELECT {unit}, paragraph, string_split({cut},chr(1)) AS parts FROM sp),
sr AS (SELECT {unit}, paragraph, unnest(parts) AS body, generate_subscripts(parts,1) AS k FROM sq),
spans AS (SELECT {unit}, paragraph, k, {kind} AS type, body FROM sr WHERE body<>'')"""


def pieces_of(body: str) -> str:
    """Number of sentences of a block, 1 at least."""
    cut = rf"""string_split(regexp_replace({body},'([.!?…])["”’''*_)\]]*\s+','\1'||chr(1),'g'),chr(1))"""
    return f"greatest(1,len(list_filter({cut}, lambda s: regexp_matches(s,'\\S'))))"


def signatures_(source: str, unit: str, order: str) -> str:
    """WITH-clauses that end in `signatures` (unit, order, sig): TYPE:sentences of a message's blocks, equal neighbours merged."""
    own = f"{unit}, {order}"
    return f"""{spans_(source, own)},
sb AS (SELECT {own}, type, {pieces_of(_TRIM.format(x="body"))} AS n, row_number() OVER (PARTITION BY {own} ORDER BY paragraph, k) AS pos FROM spans WHERE regexp_matches(body,'\\S')),
sg AS (SELECT *, pos - row_number() OVER (PARTITION BY {own}, type ORDER BY pos) AS island FROM sb),
sm AS (SELECT {own}, type, island, min(pos) AS pos, sum(n) AS n FROM sg GROUP BY ALL),
signatures AS (SELECT {own}, list(type||':'||CAST(n AS BIGINT) ORDER BY pos) AS sig FROM sm GROUP BY ALL)"""


def alike_signatures_(unit: str, order: str) -> str:
    """WITH RECURSIVE-clauses on `signatures` that end in `ratios` (unit, one, two, ratio): twice the members of matching blocks over all.

    A block is the longest common run, the first of equally long ones; then what stands left and right of it goes on.
    """
    best = """(SELECT max(struct_pack(k := k, i := -i, j := -j)) FROM (SELECT i, unnest(range(blo, bhi)) AS j FROM (SELECT unnest(range(alo, ahi)) AS i)) ij, LATERAL (SELECT unnest(range(1, least(ahi-i, bhi-j)+1)) AS k) kk WHERE a[i+1:i+k]=b[j+1:j+k])"""
    return f"""sx AS (SELECT x.{unit}, x.{order} AS one, y.{order} AS two, x.sig AS a, y.sig AS b FROM signatures x JOIN signatures y ON x.{unit}=y.{unit} AND x.{order}<y.{order}),
sd AS (SELECT DISTINCT a, b FROM sx),
sw AS (SELECT a, b, 0 AS alo, len(a) AS ahi, 0 AS blo, len(b) AS bhi, CAST(0 AS BIGINT) AS got FROM sd
UNION ALL SELECT a, b, CASE WHEN side=1 THEN alo ELSE -h.i+h.k END, CASE WHEN side=1 THEN -h.i ELSE ahi END, CASE WHEN side=1 THEN blo ELSE -h.j+h.k END, CASE WHEN side=1 THEN -h.j ELSE bhi END, CASE WHEN side=1 THEN h.k ELSE 0 END
FROM (SELECT *, {best} AS h FROM sw WHERE alo<ahi AND blo<bhi), (VALUES (1),(2)) s(side) WHERE h IS NOT NULL),
sv AS (SELECT a, b, 2*sum(got)/(len(a)+len(b)) AS ratio FROM sw GROUP BY a, b),
ratios AS (SELECT {unit}, one, two, ratio FROM sx JOIN sv USING (a, b))"""


# ---- stock expressions ----


def jaccard_words_(a: str, b: str) -> str:
    w = lambda x: f"list_distinct({tokens_(x, "[a-z0-9]+(?:''[a-z]+)?")})"
    return f"(len(list_intersect({w(a)},{w(b)}))/greatest(1,len(list_distinct(list_concat({w(a)},{w(b)})))))"


def distinct_hits_(hits: str, unit: str = "doc_id") -> str:
    """The hits (unit, i, sentence, grp, phrase, score) of each sentence, best first, without those that share half their words with one before."""
    return f"""SELECT {unit}, i, sentence, h.grp AS grp, h.phrase AS phrase, h.score AS score FROM (SELECT {unit}, i, sentence, unnest(list_reduce(list_transform(hs, lambda x: [x]),
lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {jaccard_words_('y.phrase', 'x[1].phrase')}>=0.5))>0 THEN acc ELSE list_concat(acc, x) END)) AS h
FROM (SELECT {unit}, i, sentence, list(struct_pack(grp := grp, phrase := phrase, score := score) ORDER BY score DESC, grp, phrase) AS hs FROM {hits} GROUP BY ALL))"""


# ---- echoes ----


def quotes_(x: str) -> str:
    """What stands in quotation marks, without the marks."""
    return rf"""list_transform(regexp_extract_all({x},'["“‘][^"”’]*["”’]'), lambda q: substr(q,2,length(q)-2))"""


def echoes_(pairs: str, unit: str, most: int = 10, content: int = 1, cover: float = 0.5, short: int = 4) -> str:
    """WITH-clauses that end in `echoes` (unit, echo, matched_phrase, n_words) over `pairs` (unit, text, said)."""
    gone = "said"
    for _ in range(4):
        gone = rf"regexp_replace({gone},'\[[^\[\]]*\]',' ','g')"
    asks = r"""'\?[!.…]*[ \t\n"”’''*_)\]}>]*\z'"""
    return f"""ea AS (SELECT {unit}, text, {quotes_(gone)} AS spoken FROM {pairs} WHERE contains(text,'?') AND regexp_matches(said,'["“‘]')),
eb AS (SELECT {unit}, unnest(spoken) AS s, generate_subscripts(spoken,1) AS ri FROM ea),
er AS (SELECT {unit}, ri, {tokens_('s')} AS r FROM eb),
eg AS (SELECT {unit}, gram, min(ri) AS ri FROM (SELECT {unit}, ri, k, unnest(list_transform(range(1, greatest(1, len(r)-k+2)), lambda q: array_to_string(r[q:q+k-1],' '))) AS gram FROM er, (SELECT unnest(range(1,{most + 1})) AS k)) GROUP BY ALL),
eq AS (SELECT DISTINCT {unit}, unnest(list_concat(flatten(list_transform({quotes_('text')}, lambda q: {sentences_('q')})), {narration_('text')})) AS echo FROM ea),
et AS (SELECT {unit}, echo, {tokens_('echo')} AS t FROM eq WHERE regexp_matches(echo,{asks})),
ek AS (SELECT {unit}, echo, t, i, k, array_to_string(t[i:i+k-1],' ') AS gram FROM (SELECT *, unnest(range(1, len(t)+1)) AS i FROM et WHERE len(t) BETWEEN 1 AND {most}), LATERAL (SELECT unnest(range(1, len(t)-i+2)) AS k)),
em AS (SELECT {unit}, echo, any_value(t) AS t, arg_max(struct_pack(gram := gram, k := k), k*1000000000-ri*1000-i) AS h FROM ek JOIN eg USING ({unit}, gram) GROUP BY {unit}, echo),
echoes AS (SELECT {unit}, echo, h.gram AS matched_phrase, h.k AS n_words FROM em WHERE len(list_filter(string_split(h.gram,' '), lambda w: NOT list_contains({STOP}, w)))>={content} AND (len(t)<={short} OR h.k/len(t)>={cover}))"""


# ---- conventions of markup ----

VERBATIM = r"(?s)```.*?```|\*{3,}[^\n]*?\*{3,}|\*{3,}"


def styles_(source: str, unit: str) -> str:
    """WITH-clauses that end in `styles` (unit, dialogue, narration) over the text of `source`: how many characters each kind of span covers."""
    prose = f"(SELECT {unit}, regexp_replace(coalesce(text,''),'{VERBATIM}',' ','g') AS text FROM {source})"
    trim = _TRIM.format(x="body")
    inline = r"(type='EMPHASIS' AND before='NARRATION' AND regexp_matches(left_of,'\S') AND NOT regexp_matches(left_of,'[.!?…]\s*$'))"
    return f"""{spans_(prose, unit)},
ma AS (SELECT {unit}, type, body, lag(type) OVER w AS before, lag(body) OVER w AS left_of FROM spans WINDOW w AS (PARTITION BY {unit}, paragraph ORDER BY k)),
mb AS (SELECT {unit}, sum(CASE WHEN type='SPEECH' THEN n ELSE 0 END) AS s, sum(CASE WHEN type='EMPHASIS' THEN n ELSE 0 END) AS e, sum(CASE WHEN type='NARRATION' THEN n ELSE 0 END) AS t
 FROM (SELECT {unit}, type, length({trim}) AS n FROM ma WHERE NOT coalesce({inline}, false)) GROUP BY {unit}),
mc AS (SELECT {unit}, s, t, CASE WHEN e+t=0 THEN 'unknown' WHEN e/(e+t)>=0.6 THEN 'asterisk' WHEN e/(e+t)<=0.25 THEN 'bare' ELSE 'unknown' END AS narration FROM mb),
styles AS (SELECT d.{unit.split(',')[0].strip()}{''.join(', d.' + u.strip() for u in unit.split(',')[1:])}, CASE WHEN s>0 THEN 'quoted' WHEN narration='asterisk' AND t>0 THEN 'bare' ELSE 'unknown' END AS dialogue, coalesce(narration,'unknown') AS narration
 FROM (SELECT {unit} FROM {source}) d LEFT JOIN mc USING ({unit}))"""


def settled_(values: str) -> str:
    """The value that a clear majority of the known ones agree on."""
    known = f"list_filter({values}, lambda v: v<>'unknown')"
    top = "list_max(list_transform(['quoted','asterisk','bare'], lambda v: struct_pack(n := len(list_filter({k}, lambda u: u=v)), v := v)))".format(k=known)
    return f"CASE WHEN len({known})=1 THEN {known}[1] WHEN ({top}).n>=2 AND ({top}).n/len({known})>=0.6 THEN ({top}).v ELSE 'unknown' END"


def rewritten_(source: str, unit: str) -> str:
    """WITH-clauses that end in `rewritten` (unit, new_text) over `source` (unit, text, say, tell, dialogue): quotation marks taken off where say is
    bare, emphasis where tell is bare; where tell is asterisk, what follows in a stretch without dialogue from its first bare span is wrapped.
    Rows that ask for quotation marks have a null new_text: no styled document does."""
    trim = _TRIM.format(x="body")
    inner = "trim(regexp_replace(substr(core,2,length(core)-2),'^\\s+|\\s+$','','g'))"
    inline = r"(type='EMPHASIS' AND coalesce(before='NARRATION' AND regexp_matches(left_of,'\S') AND NOT regexp_matches(left_of,'[.!?…]\s*$'), false))"
    return f"""ra AS (SELECT {unit}, say, tell, dialogue, string_split(regexp_replace(text,'({VERBATIM.replace('(?s)', '')})',chr(2)||'\\1'||chr(2),'gs'),chr(2)) AS chunks FROM {source}),
rb AS (SELECT {unit}, say, tell, dialogue, unnest(chunks) AS chunk, generate_subscripts(chunks,1) AS c FROM ra),
rc AS (SELECT {unit}, say, tell, dialogue, c, unnest(ps) AS part, generate_subscripts(ps,1) AS d FROM (SELECT *, CASE WHEN c%2=1 THEN string_split(regexp_replace(chunk,'(\\n\\s*\\n)',chr(3)||'\\1'||chr(3),'g'),chr(3)) ELSE ['',chunk] END AS ps FROM rb)),
rd AS (SELECT {unit}, say, tell, dialogue, c, d, unnest(bs) AS body, generate_subscripts(bs,1) AS k FROM (SELECT *, CASE WHEN d%2=1 THEN string_split(regexp_replace(part,'({SPAN})',chr(1)||'\\1'||chr(1),'g'),chr(1)) ELSE [part] END AS bs FROM rc)),
re AS (SELECT *, CASE WHEN d%2=0 OR k%2=1 THEN 'NARRATION' WHEN regexp_matches(body,'^["“‘]') THEN 'SPEECH' ELSE 'EMPHASIS' END AS type FROM rd WHERE body<>''),
rf AS (SELECT *, lag(type) OVER w AS before, lag(body) OVER w AS left_of, {trim} AS core FROM re WINDOW w AS (PARTITION BY {unit}, c, d ORDER BY k)),
rg AS (SELECT *, {inner} AS inside FROM rf),
rh AS (SELECT *, CASE WHEN type='SPEECH' AND say='bare' THEN CASE WHEN length(core)>=2 THEN inside ELSE core END
 WHEN type='EMPHASIS' AND tell='bare' AND NOT {inline} THEN inside||CASE WHEN regexp_matches(inside,'[\\p{{L}}\\p{{N}}]$') THEN '.' ELSE '' END ELSE body END AS new FROM rg),
ri AS (SELECT *, sum(CASE WHEN type='SPEECH' THEN 1 ELSE 0 END) OVER (PARTITION BY {unit}, c, d ORDER BY k) AS stretch FROM rh),
rj AS (SELECT *, tell='asterisk' AND d%2=1 AND type<>'SPEECH' AND max(CASE WHEN type='NARRATION' THEN 1 ELSE 0 END) OVER (PARTITION BY {unit}, c, d, stretch ORDER BY k)=1 AS wraps FROM ri),
rk AS (SELECT {unit}, say, c, d, k, new FROM rj WHERE NOT coalesce(wraps,false) UNION ALL
SELECT {unit}, any_value(say), c, d, min(k), string_agg(body,'' ORDER BY k) FROM rj WHERE wraps GROUP BY {unit}, c, d, stretch),
rl AS (SELECT rk.*, EXISTS (SELECT 1 FROM rj WHERE rj.wraps AND {' AND '.join(f'rj.{u.strip()}=rk.{u.strip()}' for u in unit.split(','))} AND rj.c=rk.c AND rj.d=rk.d AND rj.k=rk.k) AS wrapped FROM rk),
rm AS (SELECT {unit}, say, c, d, k, CASE WHEN wrapped AND regexp_matches(new,'\\S') THEN regexp_extract(new,'^(\\s*)',1)||'*'||{_TRIM.format(x="regexp_replace(new,'[*_]','','g')")}||'*'||regexp_extract(new,'(\\s*)$',1) ELSE new END AS new FROM rl),
rewritten AS (SELECT {unit}, CASE WHEN any_value(coalesce(say,''))='quoted' THEN NULL ELSE string_agg(new,'' ORDER BY c, d, k) END AS new_text FROM rm GROUP BY {unit})"""
