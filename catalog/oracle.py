"""DuckDB SQL for the registered queries. Independent of the operators; all text is ASCII."""

from __future__ import annotations

from catalog import views
from pairloom import fixed_values as fv

SIDES = f"s as ({views.SUPPLIER_ITEMS}), m as ({views.MASTER_ITEMS})"

UNIQUE_SIDES = f"""plain_s as ({views.SUPPLIER_ITEMS}), plain_m as ({views.MASTER_ITEMS}),
s as (select * replace (concat(title, ' ', substr(md5(concat('sup_id', sup_id)), 1, 6)) as title) from plain_s),
m as (select * replace (concat(mas_title, ' ', substr(md5(concat('m_id', m_id)), 1, 6)) as mas_title) from plain_m)"""


def _keys(keys: list[tuple[str, str]]) -> str:
    return " and ".join(f"s.{a} = m.{b}" for a, b in keys)


PAIRS = f"{SIDES}, p as (select * from s join m on {_keys(views.PAIR_KEYS)})"

NORM = "regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g')"
GRAMS = "unnest(list_transform(range(1, length(norm) - 2), lambda i: substr(norm, i, 4)))"

TFIDF = f"""
mn as (select m_id, {NORM.format('mas_title')} as norm from m where mas_title is not null),
sn as (select sup_id, {NORM.format('title')} as norm from s where title is not null),
mtf as (select m_id, gram, count(*) as tf from (select m_id, {GRAMS} as gram from mn) group by all),
stf as (select sup_id, gram, count(*) as tf from (select sup_id, {GRAMS} as gram from sn) group by all),
idf as (select gram, count(*) as df, ln((1 + (select count(*) from mn)) / (1 + count(*))) + 1 as idf
        from mtf group by gram),
mw as (select m_id, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by m_id)) as w
       from mtf join idf using (gram)),
sw as (select sup_id, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by sup_id)) as w
       from stf join idf using (gram)),
scored as (select sup_id, m_id, round(sum(sw.w * mw.w), 9) as score from sw join mw using (gram) group by all),
topk as (select sup_id, m_id, score, row_number() over (partition by sup_id order by score desc, m_id) as rank
         from scored qualify rank <= {fv.TOP_CANDIDATES})"""

TOKENS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"


def _winkler(jaro: str, a: str, b: str) -> str:
    same = " ".join(f"when substr({a}, 1, {n}) = substr({b}, 1, {n}) and least(length({a}), length({b})) >= {n} then {n}"
                    for n in (4, 3, 2, 1))
    return f"({jaro} + 0.1 * (case {same} else 0 end) * (1 - {jaro}))"


JARO = "jaro_similarity(title, mas_title)"
EANS = "list_filter(string_split(regexp_replace(trim(replace(eans, ',', ' ')), '\\.0$', ''), ' '), lambda e: e <> '')"
MERGED = "list_distinct([p_eans, cp_eans, cp_un_eans])"


def _cascade(source: str, title: str, tobacco: bool) -> tuple[str, str]:
    """CTEs that run the ordered patterns over ``title`` of ``source``; the last name is returned."""
    fields = ["pack_title", "size", "unit", "pieces", "pieces_count"]
    ctes = [f"c0 as (select *, {title} as term, {', '.join(f'null::varchar as {f}' for f in fields)}, "
            f"false as unit_seen from {source})"]
    patterns = fv.mining_patterns(tobacco)
    for i, pattern in enumerate(patterns):
        text = _text(pattern)
        names = fv.group_names(pattern)
        hit = f"regexp_matches(term, {text})"
        changed = [f"case when {hit} then nullif(regexp_extract(term, {text}, {names.index(f) + 1}), '') else {f} end as {f}"
                   for f in fields if f in names]
        if "unit" in names:
            changed.append(f"(unit_seen or {hit}) as unit_seen")
        changed.append(f"regexp_replace(term, {text}, '', 'g') as term")
        ctes.append(f"c{i + 1} as (select * replace ({', '.join(changed)}) from c{i})")
    return ",\n".join(ctes), f"c{len(patterns)}"


def _text(pattern: str) -> str:
    return "'(?i)" + fv._GROUP_NAME.sub("(", pattern).replace("'", "''") + "'"


def _mined(tobacco: bool) -> str:
    ctes, last = _cascade("t", "title", tobacco)
    return (f"with t as ({views.MINING_TITLES}),\n{ctes}\nselect item_id, split_part(title, ' ', 1) as brand, "
            f"pack_title, size, unit, pieces, pieces_count from {last}")


def _fully_mined(tobacco: bool) -> str:
    steps = [f"e0 as (select item_id, title as title_original, title as t0 from t)"]
    singles = [fv.RETAIL_PRICE_PATTERN] if tobacco else []
    singles += [fv.DEPOSIT_PATTERN, fv.ALCOHOL_PATTERN, fv.PACKAGING_PATTERN, fv.FORMAT_PATTERN]
    for i, pattern in enumerate(singles):
        text = _text(pattern)
        groups = ", ".join(f"nullif(regexp_extract(t{i}, {text}, {g}), '') as {name}"
                           for g, name in enumerate(fv.group_names(pattern), start=1))
        steps.append(f"e{i + 1} as (select * exclude (t{i}), {groups}, regexp_replace(t{i}, {text}, '', 'g') "
                     f"as t{i + 1} from e{i})")
    last = len(singles)
    ctes, end = _cascade(f"e{last}", f"t{last}", tobacco)
    kvp = "kvp, kvp_unit" if tobacco else "null::varchar as kvp, null::varchar as kvp_unit"
    litres = ", ".join(str(x) for x in fv.COMMON_LITRES)
    drinks = ", ".join(str(x) for x in fv.COMMON_BEVERAGE_SIZES)
    return f"""with t as ({views.MINING_TITLES}),
{', '.join(steps)},
{ctes},
u as (select *, cast(replace(size, ',', '.') as double) as num,
             regexp_replace(regexp_replace(lower(coalesce(unit, '')), '{fv.GRAM_SPELLINGS}', 'g', 'g'),
                            '{fv.LITRE_SPELLINGS}', 'l', 'g') as spelled,
             trim(regexp_replace(term, '\\s+', ' ', 'g')) as clean from {end}),
v as (select * replace (case when unit_seen then spelled else unit end as unit),
             case when not unit_seen then num when spelled = 'ml' then num * 0.001 when spelled = 'cl' then num * 0.01
                  when spelled = 'kg' then num * 1000 else num end as amount,
             case when spelled in ('ml', 'cl') then 'l' when spelled = 'kg' then 'g' else spelled end as std from u),
w as (select *, case when not unit_seen or num is null then unit
                     when std = '' and round(amount, 9) in ({litres}) then 'l' else std end as final_unit from v),
x as (select *, pack_title is null and pieces is not null and pieces_count is not null and unit_seen
                and final_unit = 'l' and round(amount, 9) in ({drinks}) as ctx from w),
y as (select *, case when ctx then concat(pieces, 'x', pieces_count) else pack_title end as pack from x)
select title_original, item_id,
       list_aggregate(list_transform(range(1, length(clean) + 1), lambda i:
         case when i > 1 and regexp_matches(substr(clean, i - 1, 1), '[A-Za-z]') then lower(substr(clean, i, 1))
              else upper(substr(clean, i, 1)) end), 'string_agg', '') as title,
       {kvp}, dpg, alcohol, packaging, format,
       regexp_replace(pack, '[*x]', 'x', 'g') as pack_title, round(amount, 6) as size, final_unit as unit,
       case when pack is not null then
         cast(cast(regexp_extract(pack, '(\\d+)\\s*[*x/]\\s*(\\d+)', 1) as bigint)
              * cast(regexp_extract(pack, '(\\d+)\\s*[*x/]\\s*(\\d+)', 2) as bigint) as varchar) else pieces end as pieces,
       case when ctx then null else pieces_count end as pieces_count
from y"""


def _features(pairs: str, sides: str = SIDES, ratio: bool = False) -> str:
    """CTEs up to ``f``: feature pairs over (sup_id, m_id) pairs, with the token-set ratio or Jaro in its place."""
    ctes, last = _cascade("s", "title", False)
    lev = "lev" if ratio else JARO
    scored = f"""{_token_set_ratio('(select title, mas_title from ids join s using (sup_id) join m using (m_id))')},
jl as (select * from j join lev using (title, mas_title))""" if ratio else "jl as (select * from j)"
    return f"""{sides}, {pairs},
{ctes},
j as (select c.sup_id, c.size as raw_size, c.unit, c.pieces as raw_pieces, c.pieces_count as raw_count, m.m_id, c.title, m.mas_title, c.default_price_cents, m.mas_dpc, m.mas_size, m.p_id, m.cp_id,
             coalesce(cast(replace(c.size, ',', '') as double), 0) as num, {EANS} as eans, {MERGED} as merged
      from ids join {last} c using (sup_id) join m using (m_id)),
{scored},
f as (select sup_id, m_id, unit, raw_size, raw_pieces, raw_count, title, mas_title, p_id, cp_id, split_part(title, ' ', 1) as brand,
             round(0.7 * {lev} + 0.3 * {_winkler(JARO, 'title', 'mas_title')}, 9) as wg_sim_score,
             abs(mas_dpc - default_price_cents) as price_diff,
             cast(len(list_intersect(merged, eans)) as int) as common_eans,
             case when len(list_intersect(merged, eans)) > 0 then 1 else 0 end as ean_match_flag,
             abs(mas_size - num) as size_diff from jl)"""


_WORD_SET = "list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9_]', ' ', 'g'), '\\s+'), lambda w: w <> '')))"
_BITS = "list_sum(list_transform(range(len(x)), lambda i: case when x[i + 1] = c then 1::hugeint << i else 0::hugeint end))::hugeint"
_STEP = "(({0} + ({0} & {1})) | ({0} - ({0} & {1}))) & ((1::hugeint << len(x)) - 1)"


def _ratio(common: str, a: str, b: str) -> str:
    return f"round_even(200 * ({common})::double / (len({a}) + len({b})), 0)"


def _token_set_ratio(pairs: str) -> str:
    """CTEs up to ``lev``: (title, mas_title, lev) of the distinct title pairs of ``pairs``.

    The common subsequence of the longer two strings is a reduction over the second one's characters; a row of bits per character
    of the first one is the state.
    """
    return f"""l0 as (select distinct title, mas_title from {pairs}),
l1 as (select *, {_WORD_SET.format('title')} as a, {_WORD_SET.format('mas_title')} as b from l0),
l2 as (select *, list_filter(a, lambda w: list_contains(b, w)) as c from l1),
l3 as (select *, array_to_string(c, ' ') as s, trim(array_to_string(list_concat(c, list_filter(a, lambda w: not list_contains(c, w))), ' ')) as x,
              trim(array_to_string(list_concat(c, list_filter(b, lambda w: not list_contains(c, w))), ' ')) as y from l2),
l4 as (select *, list_transform(string_split(y, ''), lambda c: {_BITS}) as masks from l3),
l5 as (select *, len(x) - bit_count(list_reduce(list_prepend((1::hugeint << len(x)) - 1, masks), lambda r, m: {_STEP.format('r', 'm')})) as n from l4),
lev as (select title, mas_title, case when len(a) = 0 or len(b) = 0 then 0.0::double
               else greatest({_ratio('len(s)', 's', 'x')}, {_ratio('len(s)', 's', 'y')}, {_ratio('n', 'x', 'y')}) / 100 end as lev from l5)"""


_DAMERAU = f"""with recursive {PAIRS},
d as (select title as a, mas_title as b, 0 as i, null::bigint[] as before, range(0, len(mas_title) + 1) as above
      from (select distinct title, mas_title from p)
      union all
      select a, b, i + 1, above, list_transform(range(1, len(b) + 2), lambda j: list_min(steps[1:j]) + j) from (
        select *, list_transform(range(0, len(b) + 1), lambda j: least(
          above[j + 1] + 1, case when j > 0 then above[j] + case when a[i + 1] = b[j] then 0 else 1 end end,
          case when j > 1 and i > 0 and a[i + 1] = b[j - 1] and a[i] = b[j] then before[j - 1] + 1 end) - j - 1) as steps from d where i < len(a))),
e as (select a, b, above[len(b) + 1] / greatest(len(a), len(b)) as dlev from d where i = len(a))
select sup_id, m_id, round(dlev, 6) as dlev from p join e on p.title = e.a and p.mas_title = e.b"""


# Blocks that two titles share: the longest run of equal characters (first in the left title, then in the right one) splits both, and so on.
_RATCLIFF = f"""with recursive {PAIRS},
t as (select distinct title as a, mas_title as b from p),
c as (select a, b, i, unnest(range(0, len(b))) as j from (select a, b, unnest(range(0, len(a))) as i from t)),
e as (select a, b, i, j, least(len(a) - i, len(b) - j) as most from c where a[i + 1] = b[j + 1]),
run as (select a, b, i, j, coalesce(list_position(list_transform(range(1, most + 1), lambda k: a[i + k] = b[j + k]), false) - 1, most) as n from e),
open_ as (select a, b, 0::bigint as i0, len(a)::bigint as i1, 0::bigint as j0, len(b)::bigint as j1, 0::bigint as n from t
  union all
  select a, b, case when k = 0 then i0 else i + n end, case when k = 0 then i else i1 end, case when k = 0 then j0 else j + n end, case when k = 0 then j else j1 end,
         case when k = 0 then n else 0 end
  from (select o.a, o.b, i0, i1, j0, j1, r.i, r.j, least(r.n, i1 - r.i, j1 - r.j) as n, unnest([0, 1]) as k
        from open_ o join run r on r.a = o.a and r.b = o.b and r.i >= i0 and r.i < i1 and r.j >= j0 and r.j < j1
        qualify row_number() over (partition by o.a, o.b, i0, i1, j0, j1 order by least(r.n, i1 - r.i, j1 - r.j) desc, r.i, r.j) = 1)),
f as (select a, b, 2 * sum(n) / (len(a) + len(b)) as ratcliff from open_ group by a, b)
select sup_id, m_id, round(ratcliff, 6) as ratcliff from p join f on p.title = f.a and p.mas_title = f.b"""


BLOCK_IDS = f"ids as (select s.sup_id, m.m_id from s join m on {_keys(views.PAIR_KEYS)})"
FEATURES = _features(BLOCK_IDS)
KNN = ("k as (select sup_id, list(price_diff order by price_diff) as price_knn from "
       "(select sup_id, price_diff, row_number() over (partition by sup_id order by price_diff) as nth from f) "
       f"where nth <= {fv.PRICE_NEIGHBOURS} group by sup_id), "
       "g as (select *, max(wg_sim_score) over (partition by sup_id) as best from f)")


def _scores(columns: str) -> str:
    return f"with {PAIRS}\nselect sup_id, m_id, {columns} from p"


def _rule(condition: str) -> str:
    return (f"with {FEATURES}, {KNN}\nselect sup_id, m_id, round(wg_sim_score, 6) as wg_sim_score, "
            f"case when {condition} then 1 else 0 end as match_pred from g left join k using (sup_id)")


def _automatch(condition: str, features: str) -> str:
    return f"""with {features},
b as (select *, max(wg_sim_score) over (partition by sup_id) as best from f),
r as (select *, cast(row_number() over (partition by sup_id order by wg_sim_score desc, m_id) as int) as rank
      from b where {condition} qualify rank <= {fv.AUTOMATCH_TOP})
select sup_id, title, mas_title, p_id, cp_id, rank from r"""


_TOKEN_SETS = f"list_distinct({TOKENS.format('title')}) as a, list_distinct({TOKENS.format('mas_title')}) as b"
_TOKEN_PAIRS = f"""t as (select distinct title, mas_title from p),
l as (select title, mas_title, unnest({TOKENS.format('title')}) as x,
             generate_subscripts({TOKENS.format('title')}, 1) as i from t),
r as (select title, mas_title, unnest({TOKENS.format('mas_title')}) as y,
             generate_subscripts({TOKENS.format('mas_title')}, 1) as j from t),
lr as (select title, mas_title, x, i, y, j, jaro_similarity(x, y) as sim from l join r using (title, mas_title))"""

_MONGE = f"""with {PAIRS}, {_TOKEN_PAIRS},
best as (select title, mas_title, i, max({_winkler('sim', 'x', 'y')}) as top from lr group by all),
score as (select title, mas_title, round(avg(top), 6) as melkan from best group by all)
select sup_id, m_id, melkan from p join score using (title, mas_title)"""

_SOFT = f"""with {PAIRS}, {_TOKEN_PAIRS},
lc as (select title, mas_title, x, min(i) as i, count(*) as n from l group by all),
rc as (select title, mas_title, y, min(j) as j, count(*) as n from r group by all),
w1 as (select lc.*, lc.n * 2 / (1 + case when rc.y is null then 0 else 1 end) as w
       from lc left join rc on lc.title = rc.title and lc.mas_title = rc.mas_title and lc.x = rc.y),
w2 as (select rc.*, rc.n * 2 / (1 + case when lc.x is null then 0 else 1 end) as w
       from rc left join lc on lc.title = rc.title and lc.mas_title = rc.mas_title and lc.x = rc.y),
best as (select w1.title, w1.mas_title, w1.w as wl, w2.w as wr, jaro_similarity(w1.x, w2.y) as sim
         from w1 join w2 using (title, mas_title)
         qualify row_number() over (partition by w1.title, w1.mas_title, w1.x order by sim desc, w2.j) = 1),
up as (select title, mas_title, sum(case when sim > 0.5 then wl * wr * sim else 0 end) as top from best group by all),
n1 as (select title, mas_title, sum(w * w) as sq from w1 group by all),
n2 as (select title, mas_title, sum(w * w) as sq from w2 group by all),
score as (select title, mas_title, round(top / (sqrt(n1.sq) * sqrt(n2.sq)), 6) as stfidf
          from up join n1 using (title, mas_title) join n2 using (title, mas_title))
select sup_id, m_id, stfidf from p join score using (title, mas_title)"""

_SYNTHETIC = f"""with {SIDES},
t as (select m.m_id, m.mas_cat_id, trim(s.title) as title, s.default_price_cents, s.eans, s.sup_cat_id
      from m join s on m.m_id = s.sup_id),
it as (select unnest(range(1, {fv.SHUFFLE_ITERATIONS + 1})) as iteration),
places as (select *, row_number() over (partition by mas_cat_id
             order by md5(concat('place:{fv.SPLIT_SEED}:', m_id)), m_id) as r from t),
givers as (select iteration, mas_cat_id, title, default_price_cents, eans, sup_cat_id,
             row_number() over (partition by mas_cat_id, iteration
               order by md5(concat('giver:{fv.SPLIT_SEED}:', iteration, ':', m_id)), m_id) as r from t, it)
select m_id, 0 as iteration, mas_cat_id, title, default_price_cents, eans, sup_cat_id, 1 as match from t
union all
select p.m_id, cast(g.iteration as int), p.mas_cat_id, g.title, g.default_price_cents, g.eans, g.sup_cat_id,
       case when p.title = g.title and p.default_price_cents = g.default_price_cents and p.eans = g.eans
                 and p.sup_cat_id = g.sup_cat_id then 1 else 0 end
from places p join givers g on p.mas_cat_id = g.mas_cat_id and p.r = g.r"""

def _training() -> str:
    """The synthetic pairs with scores and features; missing numbers stay missing."""
    ctes, last = _cascade("(select distinct title from y)", "title", False)
    return f"""with m0 as ({views.MASTER_ITEMS}), y as ({_SYNTHETIC}), {ctes},
yp as (select y.*, mas_title, mas_dpc, mas_size, {MERGED} as merged from y join m0 using (m_id)),
{_token_set_ratio('yp')},
z as (select yp.*, lev.lev, cast(replace(c.size, ',', '') as double) as num, {EANS.replace('eans', 'yp.eans')} as list
      from yp join lev using (title, mas_title) join {last} c using (title))
select m_id, iteration, round(0.7 * lev + 0.3 * {_winkler(JARO, 'title', 'mas_title')}, 6) as wg_sim_score, abs(mas_dpc - default_price_cents) as price_diff,
       case when len(list_intersect(merged, list)) > 0 then 1 else 0 end as ean_match_flag, abs(mas_size - num) as size_diff, match from z"""


def _all_scores(texts: dict[str, str]) -> str:
    """All ten scores: the queries of one or two scores each, joined."""
    names = ["sim_jaro_winkler", "sim_token_set_ratio", "sim_damerau", "sim_ratcliff", "sim_hamming", "sim_token_set", "sim_monge_elkan", "sim_soft_tfidf"]
    return "with " + ",\n".join(f"{n} as ({texts[n]})" for n in names) + f"\nselect * from {names[0]}" + "".join(f" join {n} using (sup_id, m_id)" for n in names[1:])


_Z = ["wg_sim_score", "price_diff", "ean_match_flag", "size_diff"]
_LABELS = "l as (select quality as y_true, toxic as y_pred from labels)"
_CELLS = """c as (select count(*) filter (y_true = 1 and y_pred = 1) as tp, count(*) filter (y_pred = 1) as pp,
             count(*) filter (y_true = 1) as ap, count(*) filter (y_true = y_pred) as ok, count(*) as n from l)"""


def _share(part: str, whole: str) -> str:
    return f"case when {whole} = 0 then 0.0 else {part} / {whole} end"


def texts() -> dict[str, str]:
    found = _texts()
    return found | {"sim_all": _all_scores(found), "training_set": _training(), "latest_training": _training()}


def _texts() -> dict[str, str]:
    norm_m = NORM.format("mas_title")
    return {
        "ngrams": f"""with {SIDES}, d as (select {norm_m} as norm, min(m_id) as rep, count(*) as n_rows from m group by 1)
select rep, n_rows, gram, count(*) as tf from (select rep, n_rows, {GRAMS} as gram from d) group by all""",
        "gram_idf": f"with {SIDES}, {TFIDF}\nselect gram, df, round(idf, 6) as idf from idf",
        "block_category": f"with {SIDES}\nselect s.sup_id, m.m_id from s join m on {_keys(views.BLOCK_KEYS)}",
        "block_tfidf_topk": f"""with {SIDES}, {TFIDF}
select sup_id, m_id, round(score, 6) as cos_score, cast(rank as int) as rank from topk""",
        "block_tfidf_unique": f"""with {UNIQUE_SIDES}, {TFIDF}
select sup_id, m_id, cast(rank as int) as rank from topk""",
        "csv_master": f"with {SIDES}\nselect row_number() over (order by m_id) - 1 as m_id, mas_title, p_id from m",
        "block_hybrid": f"""with {SIDES}, {TFIDF}, {BLOCK_IDS}
select sup_id, m_id from ids union select sup_id, m_id from topk""",
        "pair_rebuild": f"""with {PAIRS}
select sup_id, m_id, title, mas_title, default_price_cents, mas_dpc, eans, p_eans, p_id, cp_id from p""",
        "sim_token_set": f"""with {PAIRS}, q as (select sup_id, m_id, {_TOKEN_SETS} from p)
select sup_id, m_id, round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 6) as cos,
       round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as jacrd from q""",
        "sim_jaro_winkler": _scores(f"round({JARO}, 6) as jaro, round({_winkler(JARO, 'title', 'mas_title')}, 6) as jwrink"),
        "sim_hamming": _scores("""round(1 - len(list_filter(range(1, greatest(length(title), length(mas_title)) + 1),
  lambda i: substr(title, i, 1) <> substr(mas_title, i, 1))) / greatest(length(title), length(mas_title)), 6) as hamm"""),
        "sim_token_set_ratio": f"with {PAIRS}, {_token_set_ratio('p')}\nselect sup_id, m_id, round(lev, 6) as lev from p join lev using (title, mas_title)",
        "sim_damerau": _DAMERAU,
        "sim_ratcliff": _RATCLIFF,
        "sim_monge_elkan": _MONGE,
        "sim_soft_tfidf": _SOFT,
        "title_mine": _mined(False),
        "title_mine_tobacco": _mined(True),
        "title_full": _fully_mined(False),
        "title_full_tobacco": _fully_mined(True),
        "ean_clean": f"""with {SIDES}
select sup_id, array_to_string({EANS}, '|') as eans, cast(len({EANS}) as int) as n_eans from s""",
        "ean_merge": f"""with {SIDES}
select m_id, concat(p_eans, '|', cp_eans, '|', cp_un_eans) as merge_eans,
       array_to_string(list_transform(list_sort(list_transform(list_distinct(string_split(concat(p_eans, cp_eans, cp_un_eans), '')),
         lambda d: [instr(concat(p_eans, cp_eans, cp_un_eans), d), cast(d as bigint)])), lambda e: e[2]), '|') as digits from m""",
        "ean_match": f"""with {PAIRS}, q as (select sup_id, m_id, len(list_intersect({MERGED}, {EANS})) as c from p)
select sup_id, m_id, cast(c as int) as common_eans, case when c > 0 then 1 else 0 end as ean_match_flag from q""",
        "type_repair": """select p_partkey, round(p_retailprice, 2) as mas_dpc,
       case when p_size % 5 = 0 then 0.0::double else p_size * 10::double + 5 end as size,
       case when p_size % 7 = 0 then 0.0::double else p_size::double end as pieces from part""",
        "pair_features": f"""with {FEATURES}
select sup_id, m_id, brand, round(wg_sim_score, 6) as wg_sim_score, round(price_diff, 6) as price_diff, common_eans,
       ean_match_flag, round(size_diff, 6) as size_diff from f""",
        "rule_1": _rule("wg_sim_score >= 0.8 and ean_match_flag = 1"),
        "rule_2": _rule("wg_sim_score = best and list_contains(price_knn, price_diff)"),
        "rule_3": _rule("wg_sim_score = best"),
        "rule_features": f"""with {FEATURES}, {KNN}
select sup_id, m_id, round(best, 6) as wg_sim_score_max,
       array_to_string(list_transform(price_knn, lambda x: cast(x as bigint)), '|') as price_knn from g join k using (sup_id)""",
        "automatch_top3": _automatch("wg_sim_score >= 0.8 and ean_match_flag = 1", FEATURES),
        "match_rule_jaro": _automatch("wg_sim_score = best", _features("ids as (select sup_id, m_id from topk)", f"{SIDES}, {TFIDF}")),
        "match_rule": _automatch("wg_sim_score = best", _features("ids as (select sup_id, m_id from topk)", f"{SIDES}, {TFIDF}", ratio=True)),
        "feature_pipeline": f"""with {_features(BLOCK_IDS, ratio=True)}
select sup_id, m_id, brand, coalesce(cast(replace(raw_size, ',', '') as double), 0) as size, unit, coalesce(cast(raw_pieces as double), 0) as pieces,
       coalesce(cast(raw_count as double), 0) as pieces_count, round(wg_sim_score, 6) as wg_sim_score, round(price_diff, 6) as price_diff, ean_match_flag,
       round(size_diff, 6) as size_diff from f""",
        "synthetic_pairs": _SYNTHETIC,
        "standardise_features": f"with {FEATURES}\nselect sup_id, m_id, " + ", ".join(
            f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as z_{c}" for c in _Z) + " from f",
        "confusion": f"with {_LABELS}\nselect y_true, y_pred, count(*) as n from l group by all",
        "eval_metrics": f"""with {_LABELS}, {_CELLS}
select round({_share('tp', 'pp')}, 6) as precision, round({_share('tp', 'ap')}, 6) as recall, round(ok / n, 6) as accuracy,
       round({_share('2 * tp', '(pp + ap)')}, 6) as f1 from c""",
        "eval_report": f"""with {_LABELS},
k as (select y_true as cls from l union select y_pred from l),
c as (select cls, count(*) filter (y_true = cls and y_pred = cls) as tp, count(*) filter (y_pred = cls) as pp,
             count(*) filter (y_true = cls) as ap from k, l group by cls),
r as (select cls, tp, ap, {_share('tp', 'pp')} as p, {_share('tp', 'ap')} as r, {_share('2 * tp', '(pp + ap)')} as f from c)
select cast(cls as varchar) as label, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, ap as support from r
union all select 'accuracy', null, null, round(sum(tp) / sum(ap), 6), cast(sum(ap) as bigint) from r
union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), cast(sum(ap) as bigint) from r
union all select 'weighted avg', round(sum(p * ap) / sum(ap), 6), round(sum(r * ap) / sum(ap), 6),
                 round(sum(f * ap) / sum(ap), 6), cast(sum(ap) as bigint) from r""",
        "csv_round_trip": f"with {SIDES}\nselect sup_id, title, default_price_cents, eans, sup_cat_id from s",
    }
