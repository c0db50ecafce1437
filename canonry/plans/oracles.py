"""SQL that another engine can run on the same tables, by query name."""

from __future__ import annotations

import html
from html.entities import html5

from canonry.config import DEFAULT as C
from canonry.functions import text as X
from canonry.operators import adjudicate as A
from canonry.operators import names as N
from canonry.operators import search as S
from canonry.plans.queries import QUERY
from canonry.plans.synthetic import EARLIER, MISSPELT, WITH_FEEDS, WITH_ROOMS

_PREFIXES = "|".join(X.BRAND_PREFIXES)
_NORMAL = rf"regexp_replace(regexp_replace(lower(trim(name)), '^(?:{_PREFIXES})', ''), '\s+', ' ', 'g')"
_NUMBERS = r"list_distinct(regexp_extract_all(name, '\b\d{2,6}\b'))"
_KM = "2 * 6371.0e0 * atan2(sqrt({h}), sqrt(1 - {h}))".format(h="(pow(sin(radians(v.lat - u.lat) / 2), 2) + cos(radians(u.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lon - u.lon) / 2), 2))")

_NEAR = f"""{WITH_FEEDS},
prep as (select supplier, id, lat, lon, stars, list_distinct(list_filter(string_split({_NORMAL}, ' '), lambda t: t <> '')) as tokens, {_NUMBERS} as numbers from feeds),
near as (select u.supplier as us, u.id as ui, v.supplier as vs, v.id as vi, {_KM} as dist_km,
    case when len(u.tokens) + len(v.tokens) > 0 then 2.0e0 * len(list_intersect(u.tokens, v.tokens)) / (len(u.tokens) + len(v.tokens)) else 0e0 end as name_score,
    coalesce(greatest(0e0, 1 - abs(u.stars - v.stars) / 2), 0e0) as stars_score,
    len(u.numbers) > 0 and len(v.numbers) > 0 and len(list_intersect(u.numbers, v.numbers)) = 0 as apart
  from prep u join prep v on abs(u.lat - v.lat) < 0.02 and abs(u.lon - v.lon) < 0.02 where {_KM} <= {C.rescue_km}),
ranked as (select *, row_number() over (partition by us, ui order by name_score desc, vs, vi) as rank from near),
best as (select * from ranked where rank <= {C.candidates} and us <> vs)"""



def _matching(edges: str, u: str, v: str, x: str = "") -> str:
    """``matched``: of each component of ``edges`` the set without common ends whose
    weight is greatest, by trying all; for tables with small components.  ``x`` ends
    all names."""
    return f"""named{x} as (select *, {u} as u, {v} as v, round(confidence * 1e10)::bigint as w from {edges}),
links{x} as (select u as x, v as y from named{x} union select v, u from named{x}),
reach{x} as (select x, x as y from links{x} union select r.x, l.y from reach{x} r join links{x} l on l.x = r.y),
root{x} as (select x, min(y) as root from reach{x} group by x),
lined{x} as (select n.*, root, row_number() over (partition by root order by u, v) as k, count(*) over (partition by root) as m from named{x} n join root{x} on x = u),
tries{x} as (select distinct root, 0::bigint as k, m, []::varchar[] as used, []::bigint[] as taken, 0::bigint as total from lined{x}
  union all select t.root, l.k, t.m, case when take then list_concat(used, [u, v]) else used end, case when take then list_append(taken, l.k) else taken end, total + case when take then w else 0 end
  from tries{x} t join lined{x} l on l.root = t.root and l.k = t.k + 1, (values (true), (false)) as choice(take) where not take or not list_has_any(used, [u, v])),
best_of{x} as (select root, arg_max(taken, total) as taken from tries{x} where k = m group by root),
matched{x} as (select l.* exclude (u, v, w, root, k, m) from lined{x} l join best_of{x} using (root) where list_contains(taken, k))"""


_EDGES = f"""{_NEAR.replace("with b as", "with recursive b as", 1)},
pairs as (select distinct on (supplier_a, a_id, supplier_b, b_id) * from (
  select least(us, vs) as supplier_a, case when us < vs then ui else vi end as a_id, greatest(us, vs) as supplier_b, case when us < vs then vi else ui end as b_id, dist_km, name_score, stars_score, apart from best)),
tiers as (select *, dist_km > {C.max_km} as is_rescue from pairs where dist_km <= {C.max_km} or (name_score >= {C.rescue_name} and not apart)),
geo as (select *, case when is_rescue then pow(0.5, dist_km / {C.rescue_half_life_km}) else pow(0.5, dist_km / {C.half_life_km}) end as geo_score from tiers),
edges as (select *, case when is_rescue then {C.rescue_weight_name} * name_score + {C.rescue_weight_geo} * geo_score + {C.rescue_weight_stars} * stars_score
    else {C.weight_geo} * geo_score + {C.weight_name} * name_score + {C.weight_stars} * stars_score end as confidence,
    is_rescue or (name_score >= {C.least_name} and not (apart and name_score < {C.number_veto_name})) as eligible from geo),
kept as (select * exclude (apart) from edges where confidence >= {C.near_miss}),
valid as (select * from kept where eligible and confidence >= {C.accept}),
ends as (select supplier_a as supplier, a_id as id from valid union all select supplier_b, b_id from valid),
degree as (select supplier, id, count(*) as n from ends group by all),
lone as (select v.* from valid v join degree x on x.supplier = v.supplier_a and x.id = v.a_id join degree y on y.supplier = v.supplier_b and y.id = v.b_id where x.n = 1 and y.n = 1),
{_matching("valid", "concat_ws('::', supplier_a, a_id)", "concat_ws('::', supplier_b, b_id)")},
claimed as (select supplier_a as supplier, a_id as id from matched union all select supplier_b, b_id from matched),
misses as (select supplier_a, a_id, supplier_b, b_id, round(confidence, 4) as confidence, round(geo_score, 4) as geo_score, round(name_score, 4) as name_score, round(stars_score, 4) as stars_score, round(dist_km, 4) as dist_km, eligible, is_rescue
  from kept k where not exists (select 1 from matched l where (l.supplier_a, l.a_id, l.supplier_b, l.b_id) = (k.supplier_a, k.a_id, k.supplier_b, k.b_id))),
hard as (select *, geo_score - abs(name_score - 0.5) as priority from misses m where geo_score >= {C.hard_geo} and name_score >= {C.hard_name_low} and name_score < {C.hard_name_high}
  and not exists (select 1 from claimed c where c.supplier = m.supplier_a and c.id = m.a_id) and not exists (select 1 from claimed c where c.supplier = m.supplier_b and c.id = m.b_id)
  order by priority desc, supplier_a, a_id, supplier_b, b_id limit {C.hard_pairs}),
numbered as (select *, row_number() over (order by priority desc, supplier_a, a_id, supplier_b, b_id) - 1 as i, concat_ws('::', supplier_a, a_id, supplier_b, b_id) as key from hard),
judged as (select *, ('0x' || left(md5(key), 4))::int as x, x % 3 = 0 as same_hotel, x % 100 / 100.0e0 as verdict_confidence from numbered),
single as (select supplier, id from feeds f where not exists (select 1 from claimed c where c.supplier = f.supplier and c.id = f.id)),
member as (select a_id as cid, 0 as place, supplier_a as supplier, a_id as id, confidence, case when is_rescue then 'rescue' else 'geo_fuzzy' end as method from matched
  union all select a_id, 1, supplier_b, b_id, confidence, case when is_rescue then 'rescue' else 'geo_fuzzy' end from matched
  union all select id, 0, supplier, id, 1.0e0, 'singleton' from single),
record as (select m.*, f.name, f.address, f.lat, f.lon, f.stars from member m join feeds f using (supplier, id)),
node as (select cid as first_id, any_value(method) as method, any_value(confidence) as confidence, count(*) as size, string_agg(id, '|' order by place) as nodes from member group by cid),
called as (select *, printf('CAN-%05d', row_number() over (order by method = 'singleton', first_id)) as canonical_id from node)"""

_SCORE_OF_NAMES = "case when len(u.tokens) + len(v.tokens) > 0 then 2.0e0 * len(list_intersect(u.tokens, v.tokens)) / (len(u.tokens) + len(v.tokens)) else 0e0 end"
_TOKENS = f"list_distinct(list_filter(string_split({_NORMAL}, ' '), lambda t: t <> '')) as tokens"
#: The same with vectors of the feeds for names.
_SEMANTIC = (
    _EDGES.replace(_SCORE_OF_NAMES, f"greatest(0e0, (list_cosine_similarity(u.tokens, v.tokens) - {C.similarity_floor}) / {C.similarity_span})")
    .replace(_TOKENS, "embedding::double[] as tokens")
    .replace("as numbers from feeds)", f"as numbers from feeds join embeddings on vec_id = truth_key % (select count(*) from embeddings))")
)


def _grams(rows: str, normal: str) -> str:
    """Sparse vectors (``e``, a map) of the names of ``rows``, by supplier and id."""
    return f"""marked as (select supplier, id, concat('^', {normal}, '$') as m from {rows}),
grams as (select supplier, id, unnest(list_transform(range(1, greatest(length(m) - {N.GRAM - 1}, 1) + 1), lambda i: ('0x' || left(md5(substr(m, i, {N.GRAM})), 8))::bigint % {N.BINS})) as g from marked),
weights as (select g, ln((1 + (select count(*) from marked)) / (1 + count(*))) + 1 as idf from (select distinct supplier, id, g from grams) group by g),
weighed as (select supplier, id, g, count(*) * any_value(idf) as w from grams join weights using (g) group by supplier, id, g),
vectors as (select supplier, id, map(list(g), list(w / norm)) as e from (select *, sqrt(sum(w * w) over (partition by supplier, id)) as norm from weighed) group by supplier, id)"""


def _sparse(u: str, v: str) -> str:
    return f"least(1e0, coalesce(list_sum(list_transform(map_keys({u}), lambda g: {u}[g] * coalesce({v}[g], 0e0))), 0e0))"


#: The same with weighted n-grams of misspelt names.
_NGRAMS = (
    _EDGES.replace(_SCORE_OF_NAMES, _sparse("u.tokens", "v.tokens"))
    .replace(_TOKENS, "e as tokens")
    .replace("prep as (", f"plain as (select * replace ({MISSPELT} as name) from feeds),\n{_grams('plain', _NORMAL)},\nprep as (")
    .replace("as numbers from feeds)", "as numbers from plain join vectors using (supplier, id))")
)

_EARLIER = _EDGES.replace("\nfeeds as (", "\npresent as (", 1).replace(",\nprep as (", f",\nfeeds as ({EARLIER.format(feeds='present')}),\nprep as (", 1)
#: Ids of ``called``'s clusters that go on from those of the earlier feeds.
_LASTING = f"""with recursive known as ({_EARLIER} select m.id, c.canonical_id as old from member m join called c on c.first_id = m.cid),
{_EDGES.removeprefix("with recursive ")},
overlap as (select cid as key, old, count(*) as n from member join known using (id) group by cid, old),
rivals as (select *, count(*) over (partition by key) as of_key, count(*) over (partition by old) as of_old from overlap),
turn_of as (select *, row_number() over (order by n desc, old, key) as turn from rivals where of_key > 1 or of_old > 1),
chosen as (select 0::bigint as turn, []::varchar[] as keys, []::varchar[] as olds, false as taken
  union all select turn, case when free then list_append(keys, key) else keys end, case when free then list_append(olds, old) else olds end, free
  from (select t.*, c.keys, c.olds, not list_contains(c.keys, t.key) and not list_contains(c.olds, t.old) as free from chosen c join turn_of t on t.turn = c.turn + 1)),
kept_ids as (select key, old from rivals where of_key = 1 and of_old = 1 union all select key, old from turn_of join chosen using (turn) where taken),
lasting as (select first_id as key, nodes, old as canonical_id from node join kept_ids on key = first_id
  union all select first_id, nodes, printf('CAN-%05d', (select max(substr(old, 5)::bigint) from known) + row_number() over (order by method = 'singleton', first_id)) from node where first_id not in (select key from kept_ids)),
moved as (select o.old as canonical_id, case when exists (select 1 from kept_ids k where k.old = o.old) then 'split' else 'merged' end as event, l.canonical_id as other_id, n from overlap o join lasting l using (key)
  where not exists (select 1 from kept_ids k where (k.key, k.old) = (o.key, o.old)))"""

_SIX = "round(dist_km, 6) as dist_km, round(geo_score, 6) as geo_score, round(name_score, 6) as name_score, round(stars_score, 6) as stars_score, round(confidence, 6) as confidence"
_PAIR = "supplier_a, a_id, supplier_b, b_id"


def _longest(c: str) -> str:
    return f"coalesce(first(trim({c}) order by length(trim({c})) desc, place) filter (where length(trim({c})) > 0), '')"


def _case(column: str, table: tuple[tuple[str, str], ...], otherwise: str = "null") -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{p}') then '{label}'" for label, p in table) + f" else {otherwise} end"


def _pipe(c: str) -> str:
    items = f"list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda t: trim(t)), lambda t: t <> '')"
    return f"list_filter({items}, lambda t, i: list_position(list_transform({items}, lambda y: lower(y)), lower(t)) = i)"


_ROOM = f"""{WITH_ROOMS},
listed as (select supplier, hotel_id, room_id, name, {_pipe("amenities_raw")} as amenities from rooms),
whole as (select *, lower(concat_ws(' ', name, array_to_string(amenities, ' '))) as t from listed)"""


def _room_normal(c: str) -> str:
    out = f"lower({c})"
    for p, r in X.ROOM_EXPANSIONS:
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


_FOUND = rf"coalesce(nullif(regexp_extract(t, '{X.GUESTS}', 1), ''), nullif(regexp_extract(t, '{X.SLEEPS}', 1), ''))"
_RECORDS = f"{_EDGES}, own as (select cid as id, {_longest('name')} as name, {_longest('address')} as address, count(*) as size from record group by cid)"
_SIDE = "concat('{letter}=\"', {x}.name, '\" (', {x}.address, ', ', coalesce({x}.stars::varchar, 'unknown'), ' stars)')"
_LINES = f"""{_EDGES}, lines as (select i // {C.batch_pairs} as batch, i % {C.batch_pairs} as index,
  concat(i % {C.batch_pairs}, '. ', {_SIDE.format(letter="A", x="x")}, ' vs ', {_SIDE.format(letter="B", x="y")}, '; ', round(dist_km * 1000)::bigint, 'm apart.') as line
  from numbered n join feeds x on (x.supplier, x.id) = (supplier_a, a_id) join feeds y on (y.supplier, y.id) = (supplier_b, b_id))"""
_GREEDY = f"""{_EDGES}, turns as (select *, row_number() over (order by verdict_confidence desc, priority desc, supplier_a, a_id, supplier_b, b_id) as turn from judged where same_hotel),
walk as (select 0::bigint as turn, []::varchar[] as used_a, []::varchar[] as used_b, false as taken
  union all select t.turn, case when free then list_append(used_a, t.a) else used_a end, case when free then list_append(used_b, t.b) else used_b end, free
  from (select w.used_a, w.used_b, t.turn, concat_ws('::', supplier_a, a_id) as a, concat_ws('::', supplier_b, b_id) as b, not list_contains(w.used_a, a) and not list_contains(w.used_b, b) as free from walk w join turns t on t.turn = w.turn + 1) t),
accepted as (select t.* from turns t join walk w using (turn) where taken)"""
_ATTACHED = f"""{_EDGES}, attached as (select c.cid as canonical_hotel_id, s.cs as candidate_supplier, s.ci as candidate_id, confidence, geo_score, name_score from (
  select supplier_a as supplier, a_id as id, supplier_b as cs, b_id as ci, confidence, geo_score, name_score from misses
  union all select supplier_b, b_id, supplier_a, a_id, confidence, geo_score, name_score from misses) s join (select cid, supplier, id from member) c using (supplier, id))"""


def _once(items: str) -> str:
    """A list's items, each once whatever its case, between bars."""
    return f"array_to_string(list_filter({items}, lambda t, i: list_position(list_transform({items}, lambda y: lower(y)), lower(t)) = i), '|')"


_WORDS_OF = "list_filter(string_split(name, ' '), lambda t: t <> '')"
_IMAGES = f"list_transform({_WORDS_OF}, lambda t: concat('img/', lower(t)))"


#: Terms of a document, as the search cuts them.
_TERMS = r"""
with own as (select printf('DOC-%09d', doc_id) as id, coalesce(text, '') as name, coalesce(source, '') as address from documents),
cut as (select id, c, list_filter(regexp_split_to_array(strip_accents(lower(x)), '[^\p{L}\p{N}]+'), lambda t: t <> '') as terms
  from (select id, unnest([0, 1, 2]) as c, unnest([id, name, address]) as x from own)),
terms as (select id, unnest(terms) as term from cut)"""
_WORDS = QUERY.split()
_HITS = ", ".join(f"h{i} as (select id, count(*) as f from terms where starts_with(term, '{w}') group by id)" for i, w in enumerate(_WORDS))
_SCORE = " + ".join(
    f"(select greatest({S.LEAST_IDF}, ln((docs - n + 0.5) / (n + 0.5))) from (select count(*) as n from h{i}), (select count(*) as docs from own)) * h{i}.f * {S.K1 + 1} / (h{i}.f + {S.K1} * (1 - {S.B} + {S.B} * s.len / (select (select count(*) from terms) / (select count(*) from own)::double)))"
    for i in range(len(_WORDS))
)
_JOIN = "h0 " + " ".join(f"join h{i} using (id)" for i in range(1, len(_WORDS)))

_ROOM_PAIRS = f"""{_EDGES}, rooms as ({WITH_ROOMS.split("rooms as (", 1)[1]},
      placed as (select m.cid, l.supplier, l.room_id, list_distinct(list_filter(string_split({_room_normal("l.name")}, ' '), lambda t: t <> '')) as tokens, {_case("lower(concat_ws(' ', l.name, array_to_string(" + _pipe("l.amenities_raw") + ", ' ')))", X.BEDS)} as bed
        from rooms l join member m on m.supplier = l.supplier and m.id = l.hotel_id),
      both_ as (select a.cid as canonical_id, a.supplier as supplier_a, a.room_id as a_id, b.supplier as supplier_b, b.room_id as b_id, 2.0e0 * len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens)) as confidence, a.bed <> b.bed as conflict from placed a join placed b on a.cid = b.cid and a.supplier < b.supplier)"""
_ALIKE = f"confidence >= {C.room_accept} and not coalesce(conflict, false)"
_ROOM_MATCHED = f"""{_ROOM_PAIRS}, room_pairs as (select canonical_id, {_PAIR}, confidence from both_ where {_ALIKE}),
      {_matching("room_pairs", "concat_ws('::', canonical_id, supplier_a, a_id)", "concat_ws('::', canonical_id, supplier_b, b_id)", "_rooms")}"""



def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _mapped(pairs: dict) -> str:
    """A map of texts; codes of one are written as numbers, which no engine reads amiss."""
    text = lambda x: "concat(" + ", ".join(f"chr({ord(c)})" for c in x) + ")" if x else "''"
    return f"map([{', '.join(_quoted(str(k)) for k in pairs)}], [{', '.join(text(v) for v in pairs.values())}])"


#: Numbers that are references to something else than their code point.
_CODES = {n: html.unescape(f"&#{n};") for n in [*range(160), *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF))] if html.unescape(f"&#{n};") != chr(n)}
#: What is cut from both ends of a title.
_BLANKS = "concat(" + ", ".join(f"chr({n})" for n in range(0x3001) if chr(n).isspace()) + ")"
#: Titles in one pass: a reference by name is the longest name that it begins with (of two
#: letters at least), a semicolon may be missing.
_TITLES = rf"""with names as materialized (select {_mapped(html5)} as name, {_mapped(_CODES)} as code),
titles as (select page_id, regexp_extract(html, '<title>([^\n\r\x{{85}}\x{{2028}}\x{{2029}}]*?)</title>', 1) as t from pages),
parts as (select page_id, unnest(regexp_extract_all(t, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)|[^&]+|&')) as x, generate_subscripts(regexp_extract_all(t, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)|[^&]+|&'), 1) as i from titles),
named as (select page_id, i, x, case when regexp_matches(x, '^&#[0-9]') then ltrim(regexp_extract(x, '[0-9]+'), '0') end as dec, case when regexp_matches(x, '^&#[xX]') then ltrim(regexp_extract(x, '^&#[xX]([0-9a-fA-F]+)', 1), '0') end as hex,
  case when regexp_matches(x, '^&[^#]') then coalesce(list_max(list_filter(range(2, length(x)), lambda n: map_contains(name, substr(x, 2, n)))), 0) end as n, name, code from parts, names),
numbered as (select *, case when length(coalesce(dec, hex)) > 7 then 1114112 when coalesce(dec, hex) = '' then 0 when dec is not null then dec::bigint else ('0x' || hex)::bigint end as c from named),
plain as (select page_id, i, case when c > 1114111 or c between 55296 and 57343 then chr(65533) when c is not null then coalesce(code[c::varchar], chr(c::int)) when n > 0 then concat(name[substr(x, 2, n)], substr(x, n + 2)) else x end as x from numbered)
select page_id, case when t is not null then trim(coalesce(string_agg(x, '' order by i), ''), {_BLANKS}) end as title from titles left join plain using (page_id) group by page_id, t"""

ORACLES = {
    "feed_union": f"{WITH_FEEDS} select supplier, id, name, address, round(lat, 6) as lat, round(lon, 6) as lon, stars from feeds",
    "name_normalize": f"{WITH_FEEDS} select id, {_NORMAL} as normal from feeds",
    "property_numbers": rf"{WITH_FEEDS} select id, array_to_string(list_filter(regexp_extract_all(name, '\b\d{{2,6}}\b'), lambda t, i: list_position(regexp_extract_all(name, '\b\d{{2,6}}\b'), t) = i), ',') as numbers from feeds",
    "pipe_list_dedupe": f"{_ROOM} select room_id, array_to_string(amenities, '|') as amenities from listed",
    "numeric_coerce_drop": "select p_partkey, p_size + 0.5e0 as value from part where p_partkey % 5 <> 0 and p_partkey % 7 <> 0",
    "html_unescape_titles": _TITLES,
    "room_attributes": f"""{_ROOM} select room_id, {_case("t", X.BEDS)} as bed_type, {_case("t", X.MEALS, f"'{X.NO_MEAL}'")} as meal_plan, {_case("t", X.VIEWS)} as view,
      case when regexp_matches(t, '{X.NOT_SMOKING}') then false when regexp_matches(t, '{X.SMOKING}') then true end as is_smoking from whole""",
    "room_occupancy": f"""{_ROOM} select room_id, case when {_FOUND} is null then {_case("t", X.OCCUPANCY)} when {_FOUND}::int = 1 then 'Single' when {_FOUND}::int = 2 then 'Double' when {_FOUND}::int = 3 then 'Triple' else 'Family' end as occupancy from whole""",
    "room_name_normalize": f"{WITH_ROOMS} select room_id, {_room_normal('name')} as normal from rooms",
    "haversine_pairs": f"{_NEAR} select ui as a_id, vi as b_id, round(dist_km, 6) as dist_km from near where dist_km <= {C.max_km} and ui < vi",
    "topk_before_supplier_filter": f"{_NEAR} select ui as a_id, vi as b_id, rank::int as rank, round(name_score, 6) as name_score from best",
    "scored_edges": f"{_EDGES} select {_PAIR}, {_SIX}, eligible, is_rescue from kept",
    "semantic_edges": f"{_SEMANTIC} select {_PAIR}, {_SIX}, eligible, is_rescue from kept",
    "ngram_edges": f"{_NGRAMS} select {_PAIR}, {_SIX}, eligible, is_rescue from kept",
    "ngram_room_pairs": f"""{_ROOM_PAIRS}, room_names as (select supplier, room_id as id, name from rooms), {_grams("room_names", _room_normal("name"))},
      alike as (select b.*, {_sparse("u.e", "v.e")} as likeness from both_ b join vectors u on (u.supplier, u.id) = (b.supplier_a, b.a_id) join vectors v on (v.supplier, v.id) = (b.supplier_b, b.b_id))
      select canonical_id, {_PAIR}, round(likeness, 6) as confidence from alike where likeness >= {C.room_accept} and not coalesce(conflict, false)""",
    "valid_edges": f"{_EDGES} select {_PAIR}, {_SIX}, eligible, is_rescue from valid",
    "isolated_edge_matching": f"{_EDGES} select {_PAIR}, {_SIX}, eligible, is_rescue from lone",
    "dominant_edges": f"""{_EDGES}, weighed as (select concat_ws('::', supplier_a, a_id) as u, concat_ws('::', supplier_b, b_id) as v, round(confidence * 1e10)::bigint as w from valid),
      either as (select u as node, u, v, w from weighed union all select v, u, v, w from weighed)
      select u, v from weighed e where w > coalesce((select max(w) from either x where x.node = e.u and x.v <> e.v), 0) + coalesce((select max(w) from either y where y.node = e.v and y.u <> e.u), 0)""",
    "max_weight_matching": f"{_EDGES} select {_PAIR}, {_SIX}, eligible, is_rescue from matched",
    "clusters": f"{_EDGES} select canonical_id, nodes, round(confidence, 4) as confidence, method from called",
    "singletons": f"{_EDGES} select supplier, id from single",
    "near_misses": f"{_EDGES} select * from misses",
    "hard_cases": f"{_EDGES} select {_PAIR}, geo_score, name_score from hard",
    "verdict_cache_join": f"{_EDGES} select key, same_hotel, verdict_confidence from judged",
    "llm_batches": f"{_EDGES} select a_id, b_id, (i // {C.batch_pairs})::int as batch, (i % {C.batch_pairs})::int as index from numbered",
    "prompt_lines": f"{_LINES} select batch::int as batch, index::int as index, line from lines",
    "prompts": f"{_LINES} select batch::int as batch, concat('{A.PREAMBLE.replace("'", "''")}', string_agg(line, '\n' order by index)) as prompt from lines group by batch",
    "greedy_one_to_one": f"{_GREEDY} select {_PAIR}, verdict_confidence from accepted",
    "promote": f"""{_GREEDY} select nodes, round(confidence, 4) as confidence, method, null::varchar as note from node
      where first_id not in (select a_id from accepted) and first_id not in (select b_id from accepted)
      union all select concat(a_id, '|', b_id), round(verdict_confidence, 4), 'llm', 'by key' from accepted""",
    "vector_topk": """
with v as (select vec_id, embedding::double[] as e from embeddings),
s as (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 6) as similarity from v q join v c on q.vec_id % 2 <> c.vec_id % 2),
r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s)
select query_id, vec_id, similarity, rank::int as rank from r where rank <= 5""",
    "similarity_stretch": f"""
with v as (select vec_id, embedding::double[] as e from embeddings)
select b.vec_id, round(greatest(0e0, ((list_cosine_similarity(a.e, b.e) + 1) / 2 - {C.similarity_floor}) / {C.similarity_span}), 5) as stretched from v a join v b on b.vec_id = a.vec_id + 1""",
    "spend_summary": "select sum(o_orderkey % 1000)::bigint as lifetime_prompt_tokens, sum(o_custkey % 100)::bigint as lifetime_completion_tokens, (20 * count(*))::bigint as lifetime_pairs_adjudicated, 0.0::double as lifetime_cost_usd from orders",
    "merge_name_longest": f"{_RECORDS} select id, name, address from own",
    "merge_avg": f"{_EDGES} select cid as id, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, round(avg(stars), 6) as stars from record group by cid",
    "merge_list_union": f"{_EDGES} select id, {_once('words')} as amenities from (select cid as id, flatten(list({_WORDS_OF} order by place)) as words from record group by cid)",
    "canonical_hotels": f"""{_EDGES} select * replace ({_once("amenities")} as amenities, {_once("image_urls")} as image_urls) from (
      select c.canonical_id as id, {_longest("name")} as name, {_longest("address")} as address, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, round(avg(stars), 6) as stars,
      flatten(list({_WORDS_OF} order by place)) as amenities, flatten(list({_IMAGES} order by place)) as image_urls, case when count(*) > 1 then 'matched' else 'singleton' end as match_status, round(any_value(c.confidence), 4) as match_confidence, any_value(c.method) as match_method, null::varchar as match_note
      from record r join called c on c.first_id = r.cid group by c.canonical_id)""",
    "source_map": f"{_EDGES} select cid as id, string_agg(concat(supplier, '=', id), ',' order by supplier) as source_ids, case when count(*) > 1 then 'matched' else 'singleton' end as match_status, any_value(method) as match_method from member group by cid",
    "canonical_ids": f"{_EDGES} select canonical_id, first_id, method from called",
    "incremental_matching": f"{_EDGES} select {_PAIR}, {_SIX}, eligible, is_rescue from matched",
    "lasting_ids": f"{_LASTING} select canonical_id, nodes from lasting",
    "id_history": f"""{_LASTING} select canonical_id, event, other_id, n from moved
      union all select old, 'retired', null, count(*) from known where old not in (select old from overlap) group by old
      union all select canonical_id, 'new', null, len(string_split(nodes, '|')) from lasting where key not in (select key from overlap)""",
    "near_miss_attach": f"{_ATTACHED} select * from attached",
    "near_miss_top10": f"""{_ATTACHED}, ranked_ as (select *, row_number() over (partition by canonical_hotel_id order by confidence desc, candidate_supplier, candidate_id) as rank from attached)
      select canonical_hotel_id, rank::int as rank, candidate_supplier, candidate_id, confidence, geo_score, name_score, name as candidate_name, address as candidate_address from ranked_ join feeds on (supplier, id) = (candidate_supplier, candidate_id) where rank <= {C.near_misses_shown}""",
    "image_dedupe": """
with d as (select doc_id, source, 'doc/' || lpad(doc_id::varchar, 9, '0') as url, strlen(text)::varchar || ':' || md5(text) as fp from documents where text is not null),
r as (select *, row_number() over (partition by source, fp order by url) as k, count(*) over (partition by source) as n from d)
select source, count(*)::bigint as n, md5(string_agg(url, '|' order by url)) as urls_md5 from r where k = 1 or n < 2 group by source""",
    "room_pairs_scored": f"{_ROOM_PAIRS} select canonical_id, {_PAIR}, round(confidence, 6) as confidence from both_ where {_ALIKE}",
    "room_matching": f"{_ROOM_MATCHED} select canonical_id, {_PAIR}, round(confidence, 6) as confidence from matched_rooms",
    "canonical_rooms": f"""{_ROOM_MATCHED},
      paired as (select canonical_id, supplier_a as supplier, a_id as room_id from matched_rooms union all select canonical_id, supplier_b, b_id from matched_rooms),
      room_member as (select canonical_id, 0 as place, supplier_a as supplier, a_id as room_id, confidence, concat_ws('::', canonical_id, '0', supplier_a, a_id) as least from matched_rooms
        union all select canonical_id, 1, supplier_b, b_id, confidence, concat_ws('::', canonical_id, '0', supplier_a, a_id) from matched_rooms
        union all select cid, 0, supplier, room_id, 1.0e0, concat_ws('::', cid, '1', supplier, room_id) from placed p where not exists (select 1 from paired q where (q.supplier, q.room_id) = (p.supplier, p.room_id))),
      made as (select least, canonical_id, {_longest("name")} as name, flatten(list({_pipe("amenities_raw")} order by place)) as items, count(*) as size, any_value(confidence) as confidence from room_member join rooms using (supplier, room_id) group by least, canonical_id),
      told as (select *, {_once("items")} as amenities, lower(concat_ws(' ', name, replace(amenities, '|', ' '))) as t from made)
      select printf('CAN-RM-%06d', row_number() over (order by least)) as id, canonical_id as canonical_hotel_id, name, {_case("t", X.BEDS)} as bed_type,
        case when {_FOUND} is null then {_case("t", X.OCCUPANCY)} when {_FOUND}::int = 1 then 'Single' when {_FOUND}::int = 2 then 'Double' when {_FOUND}::int = 3 then 'Triple' else 'Family' end as occupancy,
        {_case("t", X.MEALS, f"'{X.NO_MEAL}'")} as meal_plan, {_case("t", X.VIEWS)} as view, case when regexp_matches(t, '{X.NOT_SMOKING}') then false when regexp_matches(t, '{X.SMOKING}') then true end as is_smoking,
        amenities, case when size > 1 then 'matched' else 'singleton' end as match_status, round(confidence, 4) as match_confidence from told""",

    "fts_search": f"{_TERMS}, {_HITS} select id as key from {_JOIN}",
    "fts_rank": f"{_TERMS}, {_HITS}, s as (select id, count(*) as len from terms group by id) select id as key, round({_SCORE}, 6) as score from {_JOIN} join s using (id)",
    "fts_top20": f"{_TERMS}, {_HITS}, s as (select id, count(*) as len from terms group by id) select id as key, round({_SCORE}, 6) as score from {_JOIN} join s using (id) order by {_SCORE} desc, id limit 20",
    "like_trigrams": f"{_RECORDS} select id, name from own where name ilike '%road%' or address ilike '%road%' order by name, id limit 50 offset 5",
    "like_fallback": f"{_RECORDS} select id, name from own where name ilike '%road%' or address ilike '%road%' order by name, id limit 50 offset 5",
    "list_page": f"{_RECORDS} select id, name from own where size > 1 order by id limit 20 offset 40",
    "stats_by_status": f"{_EDGES} select case when size > 1 then 'matched' else 'singleton' end as match_status, count(*)::bigint as n from node group by 1",
    "stats_by_method": f"{_EDGES} select method as match_method, count(*)::bigint as n from node group by 1",
    "confidence_bands": f"{_EDGES} select case when round(confidence, 4) >= 0.85 then 'high' when round(confidence, 4) >= 0.6 then 'medium' else 'low' end as band, count(*)::bigint as n from node where size > 1 group by 1",
    "match_rate": f"{_EDGES} select count(*)::bigint as total, sum((size > 1)::int)::bigint as matched, round(sum((size > 1)::int) / count(*)::double, 6) as match_rate from node",
    "rate_limit_offered": "select event_id, (count(*) over (partition by user_id order by ts range between interval 86400 seconds preceding and current row))::bigint as offered from events",
    "rate_limit_admitted": """
with recursive own as (select event_id, user_id, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
walk as (select user_id, 0::bigint as k, []::double[] as recent, null::bigint as event_id, false as admitted from (select distinct user_id from own)
  union all select user_id, k, case when free then list_append(live, t) else live end, event_id, free from (
    select o.user_id, o.k, o.t, o.event_id, list_filter(w.recent, lambda x: o.t - x <= 86400) as live, len(live) < 2 as free from walk w join own o on o.user_id = w.user_id and o.k = w.k + 1))
select event_id, admitted from walk where k > 0""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
