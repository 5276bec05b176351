"""The same queries in SQL, written apart from the DataFrame code, for a second engine to check them."""

from __future__ import annotations

from ..functions.similarity import MATCH_PUNCTUATION
from ..functions.text import CHAPTER, CJK, DECIMAL, KEYWORDS, NUM, OCR_PREFIX, PUNCTUATION, SECTION, SECTION_LATIN, SPACES, STRUCTURAL, TEXT_PREFIX, TOP_HEADING, TOP_LATIN, VOLUME

D = "::double"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACES}+', ' ', 'g'))"


def _squeeze(c: str) -> str:
    return f"regexp_replace({c}, '{SPACES}+', '', 'g')"


def _cand(c: str) -> str:
    return f"(case when regexp_matches({_norm(c)}, '{CJK}') then regexp_replace({_squeeze(_norm(c))}, '{PUNCTUATION}+', '', 'g') else {_norm(c)} end)"


def _units(c: str) -> str:
    return f"(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _join(a: str, b: str) -> str:
    x, y = _cand(a), _cand(b)
    return f"(case when {x} = '' then {y} when {y} = '' then {x} when regexp_matches({x} || {y}, '{CJK}') then {x} || {y} else {x} || ' ' || {y} end)"


def _top(c: str) -> str:
    return f"(regexp_matches({c}, '{TOP_HEADING}') or regexp_matches({c}, '{TOP_LATIN}\\b'))"


def _section(c: str) -> str:
    return f"(regexp_matches({c}, '{SECTION}') or regexp_matches({c}, '{SECTION_LATIN}\\b'))"


def _pattern(c: str) -> str:
    n = _norm(c)
    return f"(case when {n} = '' then 0{D} when {_top(n)} then 1{D} when {_section(n)} then 0.9{D} when regexp_matches({n}, '{DECIMAL}') then 1{D} else 0{D} end)"


def _semantic(c: str) -> str:
    return "(case when " + " or ".join(f"contains(lower({_norm(c)}), '{w}')" for w in KEYWORDS) + f" then 0.6{D} else 0{D} end)"


def _level(c: str) -> str:
    n = _norm(c)
    return f"(case when {n} = '' then null when {_top(n)} then 1 when {_section(n)} then 2 when regexp_matches({n}, '{DECIMAL}') then least(6, len(string_split(regexp_extract({n}, '{DECIMAL}', 1), '.')))::int end)"


def _clamp(c: str) -> str:
    return f"greatest(0{D}, least(1{D}, {c}))"


def _position(c: str) -> str:
    return f"(case when {c} <= 0.2{D} then 1{D} when {c} <= 0.4{D} then 0.6{D} when {c} <= 0.6{D} then 0.3{D} else 0.1{D} end)"


_TOTAL = _clamp(f"0.45{D} * style_score + 0.2{D} * position_score + 0.25{D} * pattern_score + 0.1{D} * semantic_score")

_LINES = f"""
parts as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents),
slots as (select doc_id, raw, string_split(raw, ' ') as w, n::int as n, (n // 4)::int as page_index, (n % 4)::int as slot, doc_id % 5 = 0 as cjk from parts),
named as (select *, '第' || substring('一二三四五六七八九十', page_index % 10 + 1, 1) || case when page_index % 6 = 0 then '卷' else '章' end as name from slots),
worded as (select *, case
    when cjk and slot = 0 and page_index % 2 = 0 then [name, array_to_string(w[1:3], ' '), array_to_string(w[4:], ' ')]
    when cjk and slot = 0 then [name, array_to_string(w[1:2], ' '), array_to_string(w[3:4], ' '), array_to_string(w[5:], ' ')]
    when cjk and slot = 2 and page_index = 1 then ['绪论', raw]
    when not cjk and slot = 0 then ['Chapter ' || (page_index + 1) || ' ' || array_to_string(w[1:3], ' '), array_to_string(w[4:], ' ')]
    when not cjk and slot = 2 then [(page_index + 1) || '.2 ' || array_to_string(w[1:3], ' '), array_to_string(w[4:], ' ')]
    else [raw] end as texts from named),
split as (select doc_id, page_index, slot, cjk, n, unnest(texts) as text, (generate_subscripts(texts, 1) - 1)::int as part from worded),
sized as (select *, (n * 4 + part)::int as line_seq, (72 + 120 * slot + 28 * part){D} as y0, part = 0 and slot = 0 as is_bold,
    (case when part = 0 and slot = 0 then 22 when part = 0 and slot = 2 and (not cjk or text = '绪论') then 18 when cjk and slot = 0 and (part = 1 or (part = 2 and page_index % 2 = 1)) then 16 else 12 end){D} as font_size from split),
lines as (select doc_id, page_index, line_seq, slot, part, text, 72{D} as x0, y0, (72 + 6 * length(text)){D} as x1, y0 + font_size as y1, font_size, is_bold, case when is_bold then 'Body-Bold' else 'Body' end as font_name, 792{D} as page_height, y0 / 792{D} as top_ratio from sized)
"""

_FRAGMENTS = f"""{_LINES},
near as (select *, {_cand("text")} as t, lead(text, 1) over p as text1, lead(text, 2) over p as text2, {", ".join(f"lead({c}, {k}) over p as {c}_{k}" for c in ("x0", "y0", "x1", "y1", "font_size", "is_bold", "font_name", "top_ratio") for k in (1, 2))}
    from lines window p as (partition by doc_id, page_index order by y0, x0, line_seq)),
joining as (select *, coalesce(regexp_matches({_squeeze("t")}, '{TEXT_PREFIX}') and top_ratio <= 0.35{D} and top_ratio_1 <= 0.38{D} and y0_1 - y1 >= -2{D} and y0_1 - y1 <= greatest(50{D}, (y1 - y0) * 2.4{D})
    and {_units(_cand("text1"))} <= 32 and font_size_1 >= font_size * 0.65{D}, false) as joins from near),
extending as (select *, joins and coalesce({_units(_cand("text2"))} <= 24 and font_size_2 >= font_size_1 * 0.8{D} and font_size_2 <= font_size_1 * 1.2{D} and y0_2 - y1_1 >= -2{D} and y0_2 - y1_1 <= greatest(36{D}, (y1_1 - y0_1) * 2{D})
    and not regexp_matches({_squeeze(_cand("text2"))}, '^[一二三四五六七八九十]'), false) as extends from joining),
leaving as (select *, joins or coalesce(lag(joins, 1) over p, false) or coalesce(lag(extends, 2) over p, false) as gone from extending window p as (partition by doc_id, page_index order by y0, x0, line_seq)),
two as (select *, {_join("text", "text1")} as joined from leaving where joins),
fragments as (
    select doc_id, page_index, line_seq, 1 as single, text, x0, y0, x1, y1, font_size, is_bold, font_name, page_height, top_ratio from leaving where not gone
    union all
    select doc_id, page_index, line_seq, 0, case when extends then {_join("joined", "text2")} else joined end,
        case when extends then least(x0, x0_1, x0_2) else least(x0, x0_1) end, case when extends then least(y0, y0_1, y0_2) else least(y0, y0_1) end,
        case when extends then greatest(x1, x1_1, x1_2) else greatest(x1, x1_1) end, case when extends then greatest(y1, y1_1, y1_2) else greatest(y1, y1_1) end,
        case when extends then greatest(font_size, font_size_1, font_size_2) else greatest(font_size, font_size_1) end, is_bold or is_bold_1 or (extends and is_bold_2), font_name, page_height,
        (case when extends then least(y0, y0_1, y0_2) else least(y0, y0_1) end) / page_height
    from two)
"""

_BODY = f"""{_FRAGMENTS},
sizes as (select doc_id, floor(font_size * 10 + 0.5){D} / 10{D} as size, count(*) as n from fragments where font_size > 0 group by all),
body_size as (select doc_id, size as body_size from sizes qualify row_number() over (partition by doc_id order by n desc, size) = 1),
names as (select doc_id, font_name, count(*) as n, min((page_index, y0, x0, single, line_seq)) as first from fragments join body_size using (doc_id) where abs(font_size - body_size) <= 1 and font_name <> '' group by all),
body_name as (select doc_id, font_name as name from names qualify row_number() over (partition by doc_id order by n desc, first) = 1),
body as (select doc_id, body_size, coalesce(name, '') as body_name from body_size left join body_name using (doc_id))
"""


def _scored(cap: int) -> str:
    return f"""{_BODY},
titled as (select * replace ({_cand("text")} as text) from fragments),
rated as (select f.*, {_clamp(f"0.6{D} * {_clamp(f'(font_size / body_size - 1{D}) / 0.55{D}')} + 0.3{D} * is_bold::int{D} + 0.1{D} * (body_name <> '' and font_name <> body_name)::int{D}")} as style_score,
    {_position("top_ratio")} as position_score, {_pattern("text")} as pattern_score, {_semantic("text")} as semantic_score
    from titled f join body using (doc_id) where {_units("text")} between 2 and 120),
scored as (select *, {_TOTAL} as total_score from rated where style_score >= 0.35{D} or pattern_score >= 0.5{D} or semantic_score >= 0.5{D}
    qualify row_number() over (partition by doc_id, page_index order by y0, x0, single, line_seq) <= {cap}),
candidates as (select *, least(6, dense_rank() over (partition by doc_id order by font_size desc))::int as bucket,
    greatest(1, least(6, coalesce({_level("text")}, least(6, dense_rank() over (partition by doc_id order by font_size desc)))))::int as level_hint from scored)
"""


_ACCEPTED = f"((semantic_score >= 0.6{D} and position_score >= 0.6{D} and style_score >= 0.45{D}) or total_score >= 0.68{D} or (pattern_score >= 1{D} and style_score >= 0.5{D}))"

_JUDGED = f"""{_scored(80)},
high as (select *, {_norm("text")} as title, {_ACCEPTED} as high from candidates),
once as (select *, row_number() over (partition by doc_id, page_index, lower(title) order by y0, x0, single, line_seq) as nth, regexp_extract({_squeeze("title")}, '{STRUCTURAL}', 1) as key from high where high and title <> ''),
kept as (select *, row_number() over (partition by doc_id, key order by page_index, y0, x0, single, line_seq) as nth_key from once where nth = 1),
nodes as (select *, row_number() over o - 1 as node_seq, regexp_matches({_squeeze("title")}, '{VOLUME}') as volume from kept where key = '' or nth_key = 1 window o as (partition by doc_id order by page_index, y0, x0, single, line_seq)),
placed as (select *, case when node_seq = 0 then 1 when volume then 1 when max(volume::int) over (partition by doc_id order by node_seq) = 1 and regexp_matches({_squeeze("title")}, '{CHAPTER}') then greatest(level_hint, 2) else level_hint end as wanted from nodes),
outline as (select doc_id, node_seq::int as node_seq, title, (min(wanted - node_seq) over (partition by doc_id order by node_seq) + node_seq)::int as level, page_index, total_score as confidence, 'rule' as source from placed)
"""

_PAGES = f"""
parts as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents),
page as (select doc_id, (n // 4)::int as page_index, sum({_units(_squeeze("raw"))})::int as char_count from parts group by all),
told as (select doc_id, count(*)::int as page_count, count(*) filter (char_count >= 20)::int as text_pages from page group by doc_id),
class as (select doc_id, case when text_pages{D} / page_count >= 0.8{D} then 'text' when text_pages{D} / page_count <= 0.2{D} then 'scanned' else 'hybrid' end as doc_type, page_count, text_pages, text_pages{D} / page_count as text_page_ratio from told)
"""

_OCR = f"""{_LINES},
coerced as (select doc_id, page_index, (slot * 4 + part)::int as line_seq, {_norm("text")} as text,
    x0, case when doc_id % 7 <> 0 then y0 else least(791{D}, 72{D} + 18{D} * (slot * 4 + part)) end as y0,
    case when doc_id % 7 <> 0 then x1 else 540{D} end as x1, case when doc_id % 7 <> 0 then y1 else least(791{D}, 72{D} + 18{D} * (slot * 4 + part)) + 12{D} end as y1,
    0.8{D} + 0.02{D} * (line_seq % 10){D} as confidence from lines where {_norm("text")} <> ''),
ocr as (select *, greatest(0{D}, y1 - y0) as height from coerced),
height as (select doc_id, coalesce(quantile_cont(case when height between 6 and 32 then height end, 0.5), 12){D} as body_height from ocr group by doc_id)
"""


def _ocr_join(a: str, b: str) -> str:
    return f"(case when regexp_matches({a} || {b}, '{CJK}') then {a} || {b} else {a} || ' ' || {b} end)"


_OCR_CANDIDATES = f"""{_OCR},
near as (select *, {", ".join(f"lead({c}, {k}) over p as {c}_{k}" for c in ("text", "x0", "y0", "x1", "y1", "confidence", "height") for k in (1, 2))} from ocr window p as (partition by doc_id, page_index order by y0, x0, line_seq)),
joining as (select *, coalesce(regexp_matches({_squeeze("text")}, '{OCR_PREFIX}') and {_units(_squeeze("text_1"))} between 1 and 28 and y0_1 - y1 <= greatest(36{D}, height * 1.8{D}), false) as joins from near),
extending as (select *, joins and coalesce({_units(_squeeze("text_2"))} between 1 and 24 and y0_2 - y1_1 <= greatest(36{D}, height_1 * 1.8{D}) and (contains({_squeeze("text_1")}, '之一') or contains({_squeeze("text_1")}, '之二')), false) as extends from joining),
leaving as (select *, joins or coalesce(lag(extends) over p, false) as gone from extending window p as (partition by doc_id, page_index order by y0, x0, line_seq)),
pieces as (
    select doc_id, page_index, line_seq, 1 as single, text, x0, y0, x1, y1, confidence, height from leaving where not gone
    union all
    select doc_id, page_index, line_seq, 0, case when extends then {_ocr_join(_ocr_join("text", "text_1"), "text_2")} else {_ocr_join("text", "text_1")} end,
        least(x0, x0_1, case when extends then x0_2 else x0 end), least(y0, y0_1, case when extends then y0_2 else y0 end), greatest(x1, x1_1, case when extends then x1_2 else x1 end), greatest(y1, y1_1, case when extends then y1_2 else y1 end),
        case when extends then ((confidence + confidence_1) / 2 + confidence_2) / 2 else (confidence + confidence_1) / 2 end,
        greatest(y1, y1_1, case when extends then y1_2 else y1 end) - least(y0, y0_1, case when extends then y0_2 else y0 end)
    from leaving where joins),
cleaned as (select * replace ({_norm("text")} as text), {_clamp(f"y0 / 792{D}")} as top_ratio from pieces),
rated as (select *, {_pattern("text")} as pattern_score, {_semantic("text")} as semantic_score, {_position("top_ratio")} as position_score from cleaned join height using (doc_id)
    where {_units("text")} between 2 and 120 and not regexp_matches({_squeeze("text")}, '^[0-9]+$') and not ({_units(_squeeze("text"))} >= 4 and not regexp_matches({_squeeze("text")}, '{CJK}') and not regexp_matches({_squeeze("text")}, '\\p{{L}}'))),
styled as (select *, {_clamp(f"greatest(case when pattern_score >= 1 then 0.6{D} when semantic_score >= 0.5{D} and top_ratio <= 0.4{D} then 0.5{D} else 0{D} end, {_clamp(f'(height / body_height - 1{D}) / 1.2{D}')}) + {_clamp(f'(confidence - 0.8{D}) / 0.2{D}')} * 0.1{D}")} as style_score from rated),
fit as (select *, {_TOTAL} as total_score, row_number() over (partition by doc_id, page_index order by y0, x0, {_units("text")}, single, line_seq) as nth from styled
    where pattern_score >= 0.5{D} or (semantic_score >= 0.5{D} and top_ratio <= 0.45{D} and {_units("text")} <= 40) or (style_score >= 0.35{D} and top_ratio <= 0.35{D} and {_units("text")} <= 40)),
capped as (select *, regexp_matches({_squeeze("text")}, '{VOLUME}') as volume, coalesce({_level("text")}, 1) as hint from fit where nth <= 80),
candidates as (select *, (case when volume then 1 when max(volume::int) over (partition by doc_id order by page_index, y0, x0, nth rows unbounded preceding) = 1 and regexp_matches({_squeeze("text")}, '{CHAPTER}') then greatest(hint, 2) else hint end)::int as level_hint from capped)
"""

_TOC = f"""{_LINES}, heads as (select doc_id, page_index, text, row_number() over (partition by doc_id order by line_seq) - 1 as k from lines where text like '第%'),
toc as (select doc_id, (k // 12)::int as source_page_index, {_norm("text")} as title, 100{D} + 30{D} * (k % 12) as y, page_index % 3 <> 0 as numbered, page_index + 3 as printed from heads),
toc_rows as (
    select doc_id, title, case when regexp_matches(title, '{CHAPTER}') then 2 else 1 end as level, printed::int as printed_page, source_page_index, y + 3{D} as y, 0.85{D} as confidence from toc where numbered
    union all select doc_id, title, 1, null, source_page_index, y, 0.9{D} from toc where regexp_matches({_squeeze("title")}, '{VOLUME}'))"""

def _key(c: str) -> str:
    return f"regexp_replace(lower({c}), '{MATCH_PUNCTUATION.replace(chr(39), chr(39) * 2)}', '', 'g')"


def _common(a: str, b: str) -> str:
    """Length of the longest common subsequence of two keys of up to 126 characters, a column of the table in the bits of a number."""
    full = f"((1::hugeint << length({a})) - 1)"
    mask = f"list_transform(string_split({b}, ''), lambda ch: list_sum(list_transform(range(0, length({a})), lambda i: case when string_split({a}, '')[i + 1] = ch then 1::hugeint << i::int else 0::hugeint end))::hugeint)"
    return f"(length({a}) - bit_count(list_reduce({mask}, lambda v, m: ((v + (v & m)) | (v & ~m)) & {full}, {full})))"


def _alike(a: str, b: str, total: str) -> str:
    held = f"(contains({a}, {b}) or contains({b}, {a}))"
    return f"(case when {a} = '' or {b} = '' then 0{D} when {held} then least({_units(a)}, {_units(b)}){D} / greatest({_units(a)}, {_units(b)}) else 2{D} * {_common(a, b)} / {total} end)"


def _title_alike(a: str, b: str) -> str:
    return f"(case when {a} in ('附录', '后记') and starts_with({b}, {a}) then 0.9{D} else {_alike(a, b, f'(length({a}) + length({b}))')} end)"


_CLUSTERS = f"""with recursive {_OCR},
read as (select doc_id, page_index, line_seq, x0, y0, y1, (y0 + y1) / 2 as c, height, row_number() over (partition by doc_id, page_index order by (y0 + y1) / 2, x0, line_seq) as nth from ocr),
fold as (
    select doc_id, page_index, line_seq, x0, y0, y1, nth, [c] as heads, 0 as row_id from read where nth = 1
    union all
    select doc_id, page_index, line_seq, x0, y0, y1, nth, case when place is null then list_append(heads, c) else heads end, coalesce(place - 1, len(heads))::int
    from (select r.*, f.heads, list_position(list_transform(f.heads, lambda h: abs(h - r.c) <= greatest(8{D}, r.height)), true) as place
        from fold f join read r on r.doc_id = f.doc_id and r.page_index = f.page_index and r.nth = f.nth + 1)
)
select doc_id, page_index, line_seq, x0, y0, y1, row_id from fold"""

_DEDUPED = f"""with recursive {_scored(80)},
keyed as (select doc_id, page_index, line_seq, text as title, level_hint as level, {_key("text")} as k, {_squeeze(_norm("text"))} as c from candidates),
read as (select *, {_units("c")} as n, row_number() over (partition by doc_id, page_index order by level, title collate en, title, line_seq) as nth from keyed),
pairs as (select a.doc_id, a.page_index, b.nth, list(a.nth) as likes from read a join read b on a.doc_id = b.doc_id and a.page_index = b.page_index and a.nth < b.nth
    where contains(a.c, b.c) or contains(b.c, a.c) or {_title_alike("a.k", "b.k")} >= 0.74{D} group by all),
known as (select r.doc_id, r.page_index, r.nth, r.n, coalesce(likes, []) as likes, max(r.nth) over (partition by r.doc_id, r.page_index) as last from read r left join pairs p on r.doc_id = p.doc_id and r.page_index = p.page_index and r.nth = p.nth),
fold as (
    select doc_id, page_index, nth, last, [nth] as kept, [n] as sizes from known where nth = 1
    union all
    select doc_id, page_index, nth, last,
        case when place is null then list_append(kept, nth) when n > sizes[place] then list_concat(list_append(kept[:place - 1], nth), kept[place + 1:]) else kept end,
        case when place is null then list_append(sizes, n) when n > sizes[place] then list_concat(list_append(sizes[:place - 1], n), sizes[place + 1:]) else sizes end
    from (select k.*, f.kept, f.sizes, list_position(list_transform(f.kept, lambda x: list_contains(k.likes, x)), true) as place
        from fold f join known k on k.doc_id = f.doc_id and k.page_index = f.page_index and k.nth = f.nth + 1)
),
held as (select doc_id, page_index, unnest(kept) as nth, generate_subscripts(kept, 1) as slot from fold where nth = last)
select s.doc_id, s.page_index, line_seq, title, level, (row_number() over (partition by s.doc_id order by s.page_index, slot) - 1)::int as node_seq from held s join read r on r.doc_id = s.doc_id and r.page_index = s.page_index and r.nth = s.nth"""

_EVALUATED = f"""with {_JUDGED},
original as (select *, {_key("title")} as k from outline),
shifted as (select doc_id, node_seq, case when node_seq % 4 = 1 then title || ' x' else title end as title, page_index + node_seq % 4 as page_index from outline where node_seq % 5 <> 3),
made as (select *, {_key("title")} as k from shifted),
pairs as (select o.doc_id, o.node_seq, m.node_seq as made_seq, o.k as a, m.k as b, abs(o.page_index - m.page_index) as delta, {_alike("o.k", "m.k", f'({_units("o.k")} + {_units("m.k")})')} as s from original o join made m using (doc_id)),
fitting as (select *, a <> '' and b <> '' and (a = b or (starts_with(a, b) and {_units("b")} >= 2) or (starts_with(b, a) and {_units("a")} >= 2) or s >= 0.72{D}) as fits from pairs),
best as (select * from fitting qualify row_number() over (partition by doc_id, node_seq order by fits::int{D} + s * 0.1{D} - least(delta, 50) * 0.01{D} desc, made_seq) = 1),
claimed as (select *, row_number() over (partition by doc_id, made_seq order by node_seq) as claim from best where fits and delta <= 2),
counts as (select doc_id, count(*) as original_count from original group by doc_id),
made_counts as (select doc_id, count(*) as made_count from made group by doc_id),
hits as (select doc_id, count(*) as matched_count, count(*) filter (delta = 0) as exact_page_matches, count(*) filter (delta <= 1) as within_1_page, count(*) filter (delta <= 2) as within_2_pages from claimed where claim = 1 group by doc_id)
select doc_id, original_count, coalesce(made_count, 0) as made_count, coalesce(matched_count, 0) as matched_count, coalesce(exact_page_matches, 0) as exact_page_matches, coalesce(within_1_page, 0) as within_1_page, coalesce(within_2_pages, 0) as within_2_pages,
    round(coalesce(matched_count, 0){D} / original_count, 3) as recall, case when coalesce(made_count, 0) = 0 then 0{D} else round(coalesce(matched_count, 0){D} / made_count, 3) end as precision
from counts left join made_counts using (doc_id) left join hits using (doc_id)"""

_SCORES = "style_score, position_score, pattern_score, semantic_score, total_score"

ORACLE = {
    "normalize_titles": f"with {_LINES} select doc_id, line_seq, {_norm('text')} as title, {_cand('text')} as candidate, regexp_matches(text, '{CJK}') as cjk from lines",
    "position_pattern_semantic": f"with {_LINES} select doc_id, line_seq, {_position('top_ratio')} as position, {_pattern('text')} as pattern, {_semantic('text')} as semantic, {_level('text')} as level from lines",
    "heading_fragments": f"with {_FRAGMENTS} select doc_id, page_index, line_seq, single, text, x0, y0, x1, y1, font_size, is_bold, font_name, top_ratio from fragments",
    "body_font_profile": f"with {_BODY} select doc_id, body_size, body_name from body",
    "scored_candidates": f"with {_scored(80)} select doc_id, page_index, line_seq, single, text, {_SCORES}, level_hint from candidates",
    "rule_stats": f"with {_scored(80)} select doc_id, {', '.join(f'round(avg({k}_score), 9) as avg_{k}_score' for k in ('style', 'position', 'pattern', 'semantic', 'total'))} from scored group by doc_id",
    "candidate_cap": f"with {_scored(1)} select doc_id, page_index, line_seq, single, text from scored",
    "font_bucket_levels": f"with {_scored(80)} select distinct doc_id, font_size, bucket from candidates",
    "accept_reject": f"with {_scored(80)} select doc_id, page_index, line_seq, single, text, {_ACCEPTED} as accepted from candidates",
    "outline_tree": f"with {_JUDGED} select * from outline",
    "rejected_nodes": f"""with {_JUDGED}
        select doc_id, page_index, text as title, 'below_threshold' as reason, total_score as score from high where not high
        union all select doc_id, page_index, text, 'empty_title', total_score from high where high and title = ''
        union all select doc_id, page_index, text, 'duplicate_same_page', total_score from once where nth > 1
        union all select doc_id, page_index, text, 'duplicate_structural_heading', total_score from kept where key <> '' and nth_key > 1""",
    "outline_text": f"with {_JUDGED} select doc_id, string_agg((page_index + 1) || '|' || repeat('-', level - 1) || '|' || title, chr(10) order by node_seq) as outline from outline group by doc_id",
    "classify_documents": f"with {_PAGES} select * from class",
    "ocr_page_routing": f"with {_PAGES} select doc_id, page_index from page join class using (doc_id) where doc_type = 'scanned' or (doc_type = 'hybrid' and char_count < 20)",
    "ocr_line_coercion": f"with {_OCR} select doc_id, page_index, line_seq, text, x0, y0, x1, y1, height from ocr",
    "ocr_body_height": f"with {_OCR} select doc_id, body_height from height",
    "ocr_candidates": f"with {_OCR_CANDIDATES} select doc_id, page_index, line_seq, single, text, {_SCORES}, level_hint from candidates",
    "ocr_accept": f"with {_OCR_CANDIDATES} select doc_id, page_index, line_seq, single, (semantic_score >= 0.6{D} and position_score >= 0.6{D} and total_score >= 0.5{D}) or total_score >= 0.85{D} as accepted from candidates",
    "items_to_lines": f"with {_LINES} select doc_id, page_index, {_norm('text')} as text, y0, y1, font_size, is_bold, font_name, top_ratio from lines where {_norm('text')} <> ''",
    "structural_entries": f"""with {_LINES}, rows as (select doc_id, line_seq, {_norm("text")} as title, case when page_index % 3 <> 0 then page_index + 3 end as printed, (page_index // 8)::int as source_page_index, line_seq{D} as y from lines where text like '第%'),
        keyed as (select *, regexp_extract({_squeeze("title")}, '{STRUCTURAL}', 1) as key from rows),
        once as (select * from keyed where key <> '' qualify row_number() over (partition by doc_id, key order by source_page_index, y, printed nulls last, line_seq) = 1),
        near as (select *, first_value(printed ignore nulls) over (p rows between 1 following and unbounded following) as after, last_value(printed ignore nulls) over (p rows between unbounded preceding and 1 preceding) as before, row_number() over p - 1 as seq from once window p as (partition by doc_id order by source_page_index, y, printed nulls last, line_seq))
        select doc_id, seq::int as entry_seq, title, case when regexp_matches(title, '{CHAPTER}') then 2 else 1 end as level, coalesce(printed, case when regexp_matches(title, '{VOLUME}') and after is not null then greatest(1, after - 2) else before end)::int as printed_page, source_page_index, y, 0.9{D} as confidence from near""",
    "toc_row_join": f"with {_TOC} select * from toc_rows",
    "toc_extent": f"""with {_TOC}, page as (select doc_id, unnest(range(0, max(source_page_index) + 2))::int as p from toc group by doc_id),
        flagged as (select *, (doc_id, p) in (select (doc_id, source_page_index) from toc_rows) as filled from page),
        began as (select doc_id, min(p) filter (filled) as b from flagged group by doc_id),
        stop as (select doc_id, any_value(b) as b, min(p) filter (not filled and p > b) - 1 as e from flagged join began using (doc_id) group by doc_id)
        select doc_id, 0 as start_page, e as content_end, e as scan_end from stop""",
    "cover_node": f"""with {_JUDGED}, moved as (select * replace (page_index + 30 as page_index) from outline),
        front as (select distinct doc_id, s as node_seq, t as title, 1 as level, 2 as page_index, 0.9{D} as confidence, 'rule' as source from moved, (values (-3, '目录'), (-2, '序言')) f(s, t)),
        long_nodes as (select doc_id, node_seq, title, level, page_index, confidence, source from front union all select doc_id, node_seq, title, level, page_index, confidence, source from moved),
        due as (select doc_id from long_nodes group by doc_id having count(*) >= 5 and count(*) filter (regexp_matches(title, '^(绪论|第{NUM}+[卷章]|尾声|后记|附录)')) >= 3)
        select * from long_nodes union all select doc_id, -1, '封面', 1, 0, 0.6{D}, 'rule' from due""",
    "same_row_clusters": _CLUSTERS,
    "title_similarity": f"""with {_scored(80)}, keyed as (select doc_id, page_index, y0, single, line_seq, {_key("text")} as a, lead({_key("text")}, 1, '') over (partition by doc_id order by page_index, y0, x0, single, line_seq) as b from candidates)
        select doc_id, line_seq, single, round({_title_alike("a", "b")}, 12) as similarity from keyed""",
    "dedupe_nodes": _DEDUPED,
    "outline_eval": _EVALUATED,
}

_OCR_ACCEPTED = f"((semantic_score >= 0.6{D} and position_score >= 0.6{D} and total_score >= 0.5{D}) or total_score >= 0.85{D})"
_BOTH = "doc_id, page_index, line_seq, text, x0, y0, style_score, position_score, pattern_score, semantic_score, total_score, level_hint"
_ROUTED_OCR = _OCR_CANDIDATES.replace("as confidence from lines where", "as confidence from lines semi join routed using (doc_id, page_index) where")
ORACLE["ocr_full_page"] = f"""with {_PAGES.replace("char_count >= 20", "char_count >= 600")},
routed as (select doc_id, page_index from page join class using (doc_id) where doc_type = 'scanned' or (doc_type = 'hybrid' and char_count < 600)),
text_candidates as (with {_scored(80)} select {_BOTH}, single, 'text' as source from candidates),
ocr_found as (with {_ROUTED_OCR} select {_BOTH}, single + 2 as single, 'ocr' as source from candidates),
candidates as (select * from text_candidates union all select * from ocr_found)
{_JUDGED[len(_scored(80)) :].replace(_ACCEPTED, f"(case when source = 'ocr' then {_OCR_ACCEPTED} else {_ACCEPTED} end)")} select * from outline"""

_OFFSETS = f"""entries as ({ORACLE["structural_entries"]}),
headings as (with {_FRAGMENTS} select doc_id, page_index, text as title, row_number() over (partition by doc_id, page_index order by gen, line_seq) - 1 as ord
    from (select doc_id, page_index, line_seq, text, 0 as gen from lines union all select doc_id, page_index, line_seq, text, 1 from fragments where single = 0) where text like '第%'),
anchors as (select doc_id, printed_page, {_key("title")} as a, row_number() over (partition by doc_id order by entry_seq) - 1 as nth from entries where printed_page is not null qualify nth < 6),
likes as (select doc_id, page_index, nth, printed_page, max({_title_alike("a", "k")}) as s from (select doc_id, page_index, {_key("title")} as k from headings where page_index between 1 and 80) join anchors using (doc_id) group by all),
rated as (select *, s - 0.01{D} * nth as score from likes where s >= 0.62{D}),
sure as (select *, min(case when score >= 0.86{D} then page_index end) over (partition by doc_id) as stop from rated),
offsets as (select doc_id, page_index as found_page, (page_index + 1 - printed_page)::int as page_offset from sure where stop is null or page_index <= stop
    qualify row_number() over (partition by doc_id order by score desc, page_index, nth) = 1)"""
ORACLE["page_offset"] = f"with {_OFFSETS} select * from offsets"


def _display(c: str) -> str:
    value = f"replace({_norm(c)}, ':', '：')"
    return f"(case when regexp_matches({value}, '{CJK}') then {_squeeze(value)} else {value} end)"


ORACLE["confirm_nodes"] = f"""with {_OFFSETS},
page_counts as (with {_LINES} select doc_id, max(page_index) + 1 as n from lines group by doc_id),
led as (select e.*, n, printed_page + page_offset - 1 as led from entries e join offsets using (doc_id) join page_counts using (doc_id) where printed_page is not null),
around as (select *, unnest(range(led - 1, led + 2))::int as p from led),
rated_pages as (select a.*, p between 0 and n - 1 as inside, h.title as there, coalesce(ord, 0) as ord, case when p between 0 and n - 1 and h.title is not null then {_title_alike(_key("a.title"), _key("h.title"))} else 0{D} end as s
    from around a left join headings h on h.doc_id = a.doc_id and h.page_index = a.p),
best as (select * from rated_pages qualify row_number() over (partition by doc_id, entry_seq order by inside desc, round(s - 0.02{D} * abs(p - led), 12) desc, p, ord) = 1),
picked as (select *, {_squeeze(_norm("title"))} as a, case when s > 0 then {_squeeze(_norm("there"))} end as b from best)
select doc_id, entry_seq, case when coalesce(regexp_matches(a, '{VOLUME}') and {_units("b")} > {_units("a")} and starts_with(b, a), false) then {_display("there")} else {_display("title")} end as title, level,
    (case when inside then p else greatest(0, least(n - 1, led)) end)::int as page_index, round(greatest(0.5{D}, least(0.95{D}, 0.6{D} + 0.35{D} * s)), 9) as confidence, 'rule' as source from picked"""

ORACLE["html_heading_lines"] = f"""with parts as (select page_id, regexp_extract_all(coalesce(html, ''), '(<(?:h1|h2|h3|p|li|b)>[^<]*)', 1) as found from pages),
each as (select page_id, unnest(found) as part, (generate_subscripts(found, 1) - 1)::int as line_seq from parts),
titled as (select page_id, line_seq, regexp_extract(part, '^<(h1|h2|h3|p|li|b)>', 1) as tag, {_norm("regexp_replace(part, '^<[^>]*>', '')")} as title from each)
select page_id, line_seq, tag, title, (case when tag = 'h1' then 22 when tag in ('h2', 'h3') then 18 else 12 end){D} as font_size, tag in ('b', 'h1', 'h2', 'h3') as is_bold, {_pattern("title")} as pattern, {_semantic("title")} as semantic, {_level("title")} as level from titled where title <> ''"""
