"""DuckDB SQL of the registered queries.

Its relational part is written anew; phrases, labels and the derived inputs come from the same tables
as the library's, so that it checks what is done with them. Whether they are the right ones is for
tests with expected labels written by hand.
"""

from __future__ import annotations

import re

from ..functions.classify import BOARD_COUNTRIES, BOARD_TITLES, LEGAL_FORMS, NO_RULE, NO_RULES, POSITIONS
from ..operators.rules import EXECUTIVE, REGIONAL, RULES, one_sigma
from ..registry import ANALYTICS_FIELD_TYPES, CATCH_ALL, COUNTRIES, FIELDS, KEEP, RESOLUTIONS, STANDARD_FIELD_TYPES
from . import derived


def text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def mapped(column: str, pairs: dict, otherwise: str = "null") -> str:
    return f"case {column} " + " ".join(f"when {text(k)} then {text(v)}" for k, v in pairs.items()) + f" else {otherwise} end"


#: What counts as white space in a key.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm(column: str) -> str:
    return f"coalesce(trim(regexp_replace({column}, '{_WHITE}+', ' ', 'g')), '')"


def any_within(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def any_word(column: str, words) -> str:
    """A word or phrase that no letter a-z or digit touches."""
    return "(" + " or ".join(f"regexp_matches({column}, {text('(^|[^a-z0-9])' + re.escape(w).replace(chr(92) + ' ', ' ') + '([^a-z0-9]|$)')})" for w in words) + ")"


def any_keyword(column: str, words) -> str:
    phrases, single = [w for w in words if " " in w], [w for w in words if " " not in w]
    return "(" + " or ".join(([any_within(column, phrases)] if phrases else []) + ([any_word(column, single)] if single else [])) + ")"


def whole_counts(sql: str) -> str:
    """``count_if`` gives a wider integer than Spark's; windows are left alone."""
    out, at = "", 0
    for m in re.finditer(r"count_if\(", sql):
        end, depth = m.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if not sql[end:].startswith(" over"):
            out += sql[at : m.start()] + f"cast({sql[m.start():end]} as bigint)"
            at = end
    return out + sql[at:]


RAW = f"""raw_values as (
    select o_orderkey as row_id, {items(derived.COUNTRY_IDS)}[c_nationkey % 15 + 1] as countryId, {items(derived.FIELD_TYPES)}[o_orderkey % 8 + 1] as fieldType,
           case o_orderkey % 13 when 0 then null when 1 then '   ' when 2 then white || ' ' || base || white when 3 then replace(base, ' ', ' ' || white) when 4 then upper(base) else base end as inputText
    from (select *, {items(derived.TITLES)}[o_custkey % 30 + 1] as base, chr({list(map(ord, derived.WHITE))}[(o_orderkey // 13) % {len(derived.WHITE)} + 1]) as white from orders join customer on o_custkey = c_custkey))"""

PLACED = f"""{RAW},
placed as (
    select *, case when countryId is null then 'Unknown' when not regexp_full_match(countryId, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then countryId
                   else coalesce({mapped("cast(cast(trunc(cast(countryId as double)) as bigint) as varchar)", {str(k): v for k, v in COUNTRIES.items()})},
                                 'Unknown (ID: ' || cast(cast(trunc(cast(countryId as double)) as bigint) as varchar) || ')') end as Country
    from (select row_id, case when countryId in ('n/a') then countryId else countryId end as countryId, fieldType, inputText from raw_values))""".replace("cast(countryId as double)", "try_cast(countryId as double)")

KEYED = f"""{PLACED},
routed as (select *, {mapped("lower(trim(fieldType))", ANALYTICS_FIELD_TYPES)} as field_key, {norm("inputText")} as raw from placed),
keyed as (select *, case when field_key = 'positions_designations' then Country else '' end as place, lower(raw) as t from routed)"""

_position = f"case when lower(place) in ({', '.join(map(text, BOARD_COUNTRIES))}) and {any_keyword('t', BOARD_TITLES)} then 'Board Member' " + " ".join(
    f"when {any_within('t', words)} then {text(label)}" for label, words in POSITIONS
) + " end"
_form = "case " + " ".join(f"when {any_keyword('t', words)} then {text(label)}" for label, words in LEGAL_FORMS) + " end"
HIT = f"case field_key when 'positions_designations' then {_position} when 'business_legal_form' then {_form} end"
OPTIONS = mapped("field_key", {k: " / ".join(f"{x}?" for x in labels[:2]) for k, (_, labels, _) in FIELDS.items()})
REASONS = f"case when field_key in ('positions_designations', 'business_legal_form') then {text(NO_RULE)} else {text(NO_RULES)} end"
UNKNOWN = """'Needs Review: no classifier for field type ' || case when fieldType is null then 'nan' when contains(fieldType, chr(39)) then chr(34) || fieldType || chr(34)
             else chr(39) || fieldType || chr(39) end"""


def finished(found: str = "null") -> str:
    """The three result columns of ``asked``, which has ``hit`` and ``found`` (the lookup's label)."""
    return f"""case when field_key is null then 'Unknown field type' when raw = '' then '{CATCH_ALL}' else coalesce({found}, hit, '{CATCH_ALL}') end as standardized_value,
        case when field_key is null then {UNKNOWN} when raw = '' then 'Needs Review' when {found} is not null or hit is not null then '' else 'Needs Review: ' || {OPTIONS} end as needs_review,
        case when field_key is null or raw = '' or {found} is not null or hit is not null then '' else {REASONS} end as review_reason"""


FIELDED = f"""fielded as (
    select o_orderkey as row_id, {items(derived.COUNTRIES)}[c_nationkey % 9 + 1] as Country, {items(derived.FIELD_VALUES)}[o_orderkey % 8 + 1] as fieldType,
           case o_orderkey % 11 when 0 then null when 1 then base || chr(160) else base end as inputText
    from (select *, {items(derived.TITLES)}[o_custkey % 30 + 1] as base from orders join customer on o_custkey = c_custkey)),
routed as (select *, {mapped("lower(trim(fieldType))", STANDARD_FIELD_TYPES)} as field_key, {norm("inputText")} as raw from fielded),
keyed as (select *, case when field_key = 'positions_designations' then Country else '' end as place, lower(raw) as t from routed),
asked as (select *, {HIT} as hit from keyed), done as (select *, {finished()} from asked)"""

MIXED = f"{KEYED}, asked as (select *, {HIT} as hit from keyed), done as (select *, {finished()} from asked)"

MASTER = f"""master as (
    select {items(derived.FIELD_KEYS)}[f + 1] as field_key, {items(derived.COUNTRIES)}[c + 1] as country, {items(derived.TITLES)}[r + 1] as raw,
           case when k = 4 then {items(derived.LEGACY)}[(r // 5) % 4 + 1]
                else {items(derived.LABELS)}[f * 3 + case when k = 2 or (k = 3 and c < 4) then c % 2 when k = 3 then l_suppkey % 3 else r % 3 end + 1] end as std
    from (select l_partkey % 5 as f, s_nationkey % 9 as c, (l_partkey // 5) % 30 as r, ((l_partkey // 5) % 30) % 5 as k, l_suppkey from lineitem join supplier on l_suppkey = s_suppkey))"""


def triples(audit: bool) -> str:
    legacy = {"Other / Unknown": CATCH_ALL, "Unknown": CATCH_ALL} | ({} if audit else {"Owner/Controller": "Owner / Controller"})
    return f"{MASTER}, triples as (select distinct field_key, country, raw, {mapped('std', legacy, 'std')} as std from master)"


_valid = "(" + " or ".join(f"(field_key = {text(k)} and std in ({', '.join(map(text, labels))}))" for k, (_, labels, _) in FIELDS.items()) + ")"
_resolutions = "resolutions(field_key, raw, resolution) as (values " + ", ".join(f"({text(f)}, {text(r)}, {text(v)})" for (f, r), v in RESOLUTIONS.items()) + ")"

BUILT = f"""{triples(False)}, {_resolutions},
answers as (select field_key, raw, count(distinct std) as n, min(std) as std from triples group by all),
decided as (select a.*, resolution from answers a left join resolutions r using (field_key, raw)),
one as (select field_key, '' as country, raw, std, 'consistent' as kind from decided where n = 1),
override as (select field_key, '' as country, raw, resolution as std, 'override' as kind from decided where n > 1 and resolution <> '{KEEP}'),
kept as (select t.field_key, t.country, t.raw, min(t.std) as std, case when count(*) > 1 then 'ambiguous' else 'country' end as kind
         from triples t join decided d on t.field_key = d.field_key and t.raw = d.raw where d.n > 1 and resolution = '{KEEP}' group by t.field_key, t.country, t.raw),
parts as (select *, {_valid} as ok from (select * from one union all select * from override union all select * from kept)),
lookup as (select field_key, case kind when 'country' then 'by_country' else 'consistent' end as tier, country, raw, std from parts where ok and kind <> 'ambiguous')"""

FOUND = f"""{KEYED}, {BUILT.replace("with ", "")},
found as (select k.*, coalesce(o.std, g.std) as found from keyed k
          left join lookup o on o.tier = 'by_country' and o.country <> '' and o.field_key = k.field_key and o.country = k.place and o.raw = k.raw
          left join lookup g on g.tier = 'consistent' and g.field_key = k.field_key and g.raw = k.raw),
asked as (select *, {HIT} as hit from found), done as (select *, {finished("found")} from asked)"""

STATS = f"""{FOUND},
per_key as (select coalesce(fieldType, 'nan') as field_type, field_key, place, raw, count(*) as n, count_if(starts_with(needs_review, 'Needs Review')) as flagged, max(found) as found from done group by all),
stats as (
    select field_type, field_key, cast(sum(n) as bigint) as total_rows, cast(sum(case when field_key is not null and raw = '' then n else 0 end) as bigint) as blanks,
           count_if(field_key is not null and raw <> '') as unique_values, cast(sum(case when field_key is not null and raw <> '' then n - 1 else 0 end) as bigint) as duplicates,
           count_if(field_key is not null and raw <> '' and found is not null) as lookup_hits, cast(sum(flagged) as bigint) as flagged
    from per_key group by field_type, field_key),
run as (select *, cast(ceil((unique_values - lookup_hits) / 10.0) as bigint) as batches, duplicates + blanks + lookup_hits as calls_saved from stats)"""

CONFLICTS = f"""{triples(True)}, {_resolutions},
fields(field_key, field_order, display_name) as (values {", ".join(f"({text(k)}, {n}, {text(v[0])})" for n, (k, v) in enumerate(FIELDS.items()))}),
conflicts as (select field_key, raw, count(distinct std) as n, string_agg(distinct std, ' | ' order by std) as answers from triples group by all having count(distinct std) > 1)"""

INPUTS = f"inputs as (select o_orderkey // 20 as batch_id, o_orderkey % 20 + 1 as idx, {items(derived.TITLES)}[o_custkey % 30 + 1] as raw, o_orderkey % 11 as m, {items(FIELDS['positions_designations'][1])}[o_custkey % 6 + 1] as label from orders)"
LINES = f"""{INPUTS},
responses as (
    select batch_id, string_agg(case m when 1 then h || ' | MEDIUM | Reason: close call' when 2 then h || ' | LOW | Alternatives: Director, , Board Member | Reason: too short' when 3 then h
                                       when 5 then h || ' | HIGH' || chr(10) || idx || ') {CATCH_ALL} | low' when 6 then (idx + 100) || '. ' || label || ' | HIGH' else h || ' | HIGH' end,
                                chr(10) order by idx desc) filter (where m <> 4)
           || chr(10) || case when batch_id % 7 = 0 then '[Total: 19 of 21 mapped]' else '[Total: 20 of 20 mapped]' end as response
    from (select *, idx || '. ' || label as h from inputs) group by batch_id),
lines as (select batch_id, generate_subscripts(l, 1) as line_no, unnest(l) as line from (select batch_id, string_split(response, chr(10)) as l from responses)),
parsed as (
    select batch_id, line_no, cast(regexp_extract(line, '^([0-9]+)', 1) as bigint) as idx,
           regexp_extract(line, '^[0-9]+[.)] (.+?)( [|] .*)?$', 1) as std,
           upper(regexp_extract(line, '^[0-9]+[.)] .+? [|] (HIGH|MEDIUM|LOW|low)', 1)) as confidence,
           array_to_string(list_filter(list_transform(string_split(regexp_extract(line, 'Alternatives: (.*) [|] Reason', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '; ') as alternatives,
           regexp_extract(line, 'Reason: (.*)$', 1) as reasoning
    from lines where regexp_matches(line, '^[0-9]')),
firsts as (select *, row_number() over (partition by batch_id, idx order by line_no) as n, count_if(confidence <> '') over (partition by batch_id, idx) as tagged from parsed)"""

EVENTS = f"""e as (select *, user_id % 5 as f from events),
submissions as (
    select event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as submitted_at, {items(derived.FIELD_KEYS)}[f + 1] as field_key, {items(derived.COUNTRIES)}[(user_id // 5) % 9 + 1] as country,
           {items(derived.TITLES)}[user_id % 30 + 1] as raw_value, {items(derived.LABELS)}[f * 3 + event_id % 3 + 1] as proposed
    from e where event_type not in ('purchase', 'error')),
pointed as (
    select *, last_value(case when event_type not in ('purchase', 'error') then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as id
    from events),
decisions as (
    select id, case event_type when 'purchase' then 'approved' else 'rejected' end as status, strftime(ts, '%Y-%m-%d %H:%M:%S') as reviewed_at, event_id % 2 = 0 as upd,
           row_number() over (partition by id order by strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id) as n
    from pointed where event_type in ('purchase', 'error') and id is not null),
queue as (
    select s.*, coalesce(status, 'pending') as status, reviewed_at, '' as reviewer_note, coalesce(status = 'approved' and upd, false) as needs_prompt_update
    from submissions s left join (select * from decisions where n = 1) d on s.id = d.id)"""

TRUTH = f"""{triples(True)}, labelled as (select field_key, raw, count(distinct std) as n, min(std) as expected from triples where std <> '' group by all),
keys as (select field_key, raw, expected, '' as place, lower(raw) as t from labelled where n = 1),
scores as (select *, hit is not null as sure, coalesce(hit, '{CATCH_ALL}') as std, coalesce(hit, '{CATCH_ALL}') = expected as correct from (select *, {HIT} as hit from keys))"""

PLAN = f"""{KEYED}, seen as (select field_key, place as country, raw, min(row_id) as first_row from keyed where field_key is not null and raw <> '' group by all),
plan as (select *, (row_number() over (partition by field_key order by first_row) - 1) as p from seen)"""

_DIFF = "case when row_id % 17 = 0 then 'Director' when row_id % 19 = 0 then '' else standardized_value end as proposed"


def _rule_rows(field_key: str) -> str:
    values = derived.RULE_VALUES[field_key]
    raw = f"{items(values)}[o_custkey % {len(values)} + 1]"
    places = derived.REGIONS if field_key == "positions_designations" else derived.COUNTRIES
    return f"""rows as (select o_orderkey as row_id, {items(places)}[o_orderkey % {len(places)} + 1] as country, case when o_orderkey % 3 = 0 then upper({raw}) else {raw} end as raw from orders),
        low as (select *, lower(raw) as t from rows)"""


def _rule(kind: str, phrases: tuple[str, ...]) -> str:
    if kind == "exact":
        return f"t in ({', '.join(map(text, phrases))})"
    if kind == "prefix":
        return "(" + " or ".join(f"starts_with(t, {text(p)})" for p in phrases) + ")"
    if kind == "word":
        return any_word("t", phrases)
    if kind == "within":
        return any_within("t", phrases)
    return "(" + " or ".join(f"regexp_matches(t, {text(p)})" for p in phrases) + ")"


def rules_sql(field_key: str) -> str:
    cases = " ".join(f"when {_rule(kind, phrases)} then {text(label)}" for kind, label, phrases in RULES[field_key])
    return f"with {_rule_rows(field_key)} select row_id, raw, case {cases} else '{CATCH_ALL}' end as label from low"


def _client_label() -> str:
    own = lambda rules: "case " + " ".join(f"when {_rule(kind, phrases)} then {text(label)}" for kind, label, phrases in rules) + " end"
    positions = [("within", label, words) for label, words in POSITIONS]
    return "case field_key " + " ".join(f"when {text(k)} then {own(rules)}" for k, rules in (RULES | {"positions_designations": positions}).items()) + " end"


def _regional() -> str:
    cases = ""
    fits = lambda titles: any_word("s", map(one_sigma, titles))
    for names, (board, management) in REGIONAL.items():
        outright = f"when {fits(EXECUTIVE[names])} then 'Executive Management'" if names in EXECUTIVE else ""
        own = f"case when {fits(board)} then 'Board Member' {outright} when {fits(management)} and general in ('Board Member', 'Director') then 'Executive Management' else general end"
        cases += f" when p in ({', '.join(map(text, names))}) then {own}"
    return f"""with {_rule_rows("positions_designations")},
        g as (select *, replace(t, 'ς', 'σ') as s, lower(country) as p, coalesce({_position.replace("place", "country")}, '{CATCH_ALL}') as general, ['LLC', 'Corporation', 'LLP', null][row_id % 4 + 1] as form from low)
        select row_id, raw, country, case when {any_word("t", ["governor"])} then case when form in ('LLC', 'LLP') then 'Owner / Controller' else 'Director' end
            else case {cases} else general end end as label from g"""


_WARN = """with {lines}, asked as (select batch_id, idx from inputs), got as (select batch_id, idx, tagged, confidence from firsts where n = 1),
item as (select coalesce(a.batch_id, g.batch_id) as batch_id, coalesce(a.idx, g.idx) as idx, a.idx is not null as asked, g.idx is not null as answered,
                case when g.idx is not null then tagged - cast(confidence <> '' as int) else 0 end as repeats, confidence
         from asked a full join got g on a.batch_id = g.batch_id and a.idx = g.idx),
own as (select batch_id, string_agg(w, '; ' order by idx, o) as w from (
            select batch_id, idx, 1 as o, 'duplicate output for item ' || idx as w from item where repeats > 0
            union all select batch_id, idx, 2, 'item ' || idx || ': no confidence tag parsed' from item where answered and confidence = ''
            union all select batch_id, idx, 3, 'no output returned for item ' || idx from item where not answered) group by batch_id),
counts as (select batch_id, count_if(asked) as expected, count_if(answered) as answered, string_agg(case when not asked then cast(idx as varchar) end, ', ' order by idx) as extra from item group by batch_id),
totals as (select batch_id, cast(regexp_extract(response, 'Total: ([0-9]+) of ([0-9]+)', 1) as bigint) as x, cast(regexp_extract(response, 'Total: ([0-9]+) of ([0-9]+)', 2) as bigint) as y from responses),
texts as (select c.batch_id, concat_ws('; ', w, case when y <> expected then 'model''s [Total: … of ' || y || '] != ' || expected || ' inputs sent' end,
                 case when extra is not null then 'output had out-of-range item numbers: [' || extra || ']' end,
                 case when answered <> expected then 'parsed ' || answered || ' outputs for ' || expected || ' inputs' end,
                 case when x <> answered then 'model reported ' || x || ' mapped but ' || answered || ' lines parsed' end) as warnings
          from counts c left join own o on c.batch_id = o.batch_id left join totals t on c.batch_id = t.batch_id)
select batch_id, warnings, warnings = '' as ok from texts"""

_SINGLE = "row_id, Country as country, inputText as inputtext, standardized_value, needs_review, review_reason"
_AUDIT = f"""with {CONFLICTS},
    ranked as (select c.*, display_name, row_number() over (order by field_order, raw) as g from conflicts c join fields using (field_key))"""

_DIFFS = f"""with {MIXED}, o as (select *, coalesce(trim(fieldType), '') as ft, {_DIFF} from done where raw <> ''),
        f as (select ft, raw, arg_min(standardized_value, row_id) as original, arg_min(Country, row_id) as c from o group by all),
        d as (select coalesce(field_key, '') as field_key, o.raw, c, original, proposed, row_id from o join f on o.ft = f.ft and o.raw = f.raw where proposed not in ('', original)),
        n as (select *, row_number() over (partition by field_key, raw, c order by row_id) as n from d)
        select field_key, raw as raw_value, c as country, original, proposed from n where n = 1"""

ORACLE_SQL: dict[str, str] = {
    "standardize_positions": f"with {MIXED} select {_SINGLE} from done where field_key = 'positions_designations'",
    "standardize_legal_form": f"with {MIXED} select {_SINGLE} from done where field_key = 'business_legal_form'",
    "standardize_mixed": f"with {FIELDED} select row_id, Country as country, fieldType as field, inputText as value, standardized_value, needs_review, review_reason from done",
    "layouts": f"""with {FIELDED} select * from (values ('export', 'analytics'), ('fields', (select case when count(field_key) > 0 then 'mixed' else 'single' end from routed)),
        ('no known field', (select case when count(field_key) > 0 then 'mixed' else 'single' end from routed where fieldType like 'Odd%' or fieldType is null)), ('values', 'single')) v(name, layout)""",
    "table_round_trip": f"""select o_orderkey as row_id, {items(derived.COUNTRIES[:8])}[o_orderkey % 8 + 1] as country,
        case when o_orderkey % 5 = 0 then null else {items(derived.TITLES)}[o_custkey % 30 + 1] || {items(derived.ENDINGS)}[o_orderkey % 5 + 1] end as value from orders""",
    "master_round_trip": f"with {MASTER} select field_key, country, raw, std, count(*) as n from master group by all",
    "export_columns": f"with {MIXED} select Country as country, fieldType as fieldtype, inputText as inputtext, standardized_value, needs_review, review_reason, count(*) as n from done group by all",
    "standardize_analytics": f"with {MIXED} select countryId as countryid, fieldType as fieldtype, {_SINGLE} from done",
    "standardize_with_lookup": f"with {FOUND} select countryId as countryid, fieldType as fieldtype, {_SINGLE} from done",
    "resolve_countries": f"with {PLACED} select row_id, Country as country from placed",
    "field_type_summary": f"""with {KEYED} select fieldType as field_type, field_key, {mapped("field_key", {k: v[0] for k, v in FIELDS.items()})} as display_name, count(*) as row_count,
        field_key is not null as known from keyed group by fieldType, field_key""",
    "build_lookup": f"with {BUILT} select * from lookup",
    "lookup_json": f"with {BUILT} select * from lookup",
    "lookup_counters": f"""with {BUILT} select field_key, count_if(kind = 'consistent' and ok) as consistent, count_if(kind = 'country' and ok) as country_specific, count_if(kind = 'override' and ok) as resolved,
        count_if(kind <> 'ambiguous' and not ok) as skipped_invalid, count_if(kind = 'ambiguous') as skipped_ambiguous, count_if(kind <> 'ambiguous' and ok) as total_entries from parts group by rollup (field_key)""",
    "lookup_resolve": f"with {FOUND} select distinct field_key, place as country, raw, found as std from done where field_key is not null and raw <> ''",
    "conflict_audit": f"""{_AUDIT} select display_name as field, cast(g as int) as conflict_group, t.raw as raw_value, cast(n as int) as num_answers, answers as all_answers, std as standardized_value, country,
        coalesce(resolution, '') as resolution, t.field_key from triples t join ranked r on t.field_key = r.field_key and t.raw = r.raw
        left join resolutions x on t.field_key = x.field_key and t.raw = x.raw""",
    "conflict_summary": f"with {CONFLICTS} select f.field_key, count(raw) as conflicts from fields f left join conflicts c on f.field_key = c.field_key group by rollup (f.field_key)",
    "conflict_lines": f"""with {CONFLICTS}, n as (select t.field_key, t.raw, t.std, list(distinct country order by country) as cs from triples t join conflicts c on t.field_key = c.field_key and t.raw = c.raw group by all)
        select field_key, raw as raw_value, std as standardized_value, '    -> ''' || std || '''  [' || array_to_string(cs[1:8], ', ') || case when len(cs) > 8 then '...' else '' end || ']' as line from n""",
    "conflict_text": f"""{_AUDIT}, n as (select t.field_key, t.raw, t.std, display_name, g, list(distinct country order by country) as cs from triples t join ranked r on t.field_key = r.field_key and t.raw = r.raw group by all),
        c as (select field_key, min(g) as first, count(distinct g) as many from n group by field_key),
        lines as (select g, std, case when g = first and std = min(std) over raws then chr(10) || repeat('=', 60) || chr(10) || 'FIELD: ' || display_name || '  (' || many || ' conflicting raw values)' || chr(10) || repeat('=', 60) || chr(10) else '' end
                || case when std = min(std) over raws then chr(10) || '  Raw: ' || chr(39) || raw || chr(39) || chr(10) else '' end
                || '    -> ' || chr(39) || std || chr(39) || '  [' || array_to_string(cs[1:8], ', ') || case when len(cs) > 8 then '...' else '' end || ']' as line
            from n join c using (field_key) window raws as (partition by field_key, raw))
        select cast(0 as int) as part, string_agg(line, chr(10) order by g, std) as text from lines having count(*) > 0""",
    "unresolved_conflicts": f"with {CONFLICTS} select field_key, raw from conflicts anti join resolutions using (field_key, raw)",
    "resolution_use": f"with {CONFLICTS} select resolution, count(*) as n from conflicts join resolutions using (field_key, raw) group by resolution",
    "run_stats": f"with {STATS} select * from run",
    "run_totals": f"""with {STATS} select {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("total_rows", "blanks", "unique_values", "duplicates", "lookup_hits", "flagged", "batches", "calls_saved"))},
        string_agg(distinct case when field_key is null then field_type end, ', ' order by case when field_key is null then field_type end) as unknown_types from run""",
    "observed_stats": f"""with {MIXED} select case when field_key is not null then lower(trim(fieldType)) end as type_text, field_key, count(*) as total_rows, count(case when field_key is not null and raw = '' then 1 end) as blanks,
        count(case when starts_with(needs_review, 'Needs Review') then 1 end) as flagged from done group by 1, 2""",
    "run_log": f"""with {STATS}, {INPUTS} select '2024-01-01T00:00:00+00:00' as timestamp, 'orders' as source_file,
        cast((select sum(total_rows) from run) - (select count(*) from inputs where batch_id % 7 = 0) as bigint) as output_count, (select count(distinct batch_id) from inputs where batch_id % 7 = 0) as batches_failed""",
    "run_records": f"""with {STATS}, {INPUTS}, lost as (select 'first' as source_file, count(distinct batch_id) as b, count(*) as v from inputs where batch_id % 7 = 0 union all select 'second', 0, 0)
        select '2024-01-01T00:00:00+00:00 ' || source_file as timestamp, source_file, 'inputText' as raw_column, cast(sum(total_rows) as bigint) as total_rows, cast(sum(blanks) as bigint) as blank_rows,
               cast(sum(unique_values) as bigint) as unique_values_sent, cast(sum(duplicates) as bigint) as duplicates_reused, cast(sum(batches) as bigint) as batches_total, any_value(b) as batches_failed,
               any_value(v) as values_failed, cast(2 as bigint) as retries_used, cast(sum(flagged) as bigint) as flagged_count, any_value(v) as values_listed from run, lost group by source_file""",
    "parse_responses": f"""with {LINES} select i.batch_id, i.idx, i.raw, coalesce(std, '') as std, coalesce(confidence, '') as confidence, coalesce(alternatives, '') as alternatives, coalesce(reasoning, '') as reasoning,
        coalesce(confidence, '') in ('', 'LOW') as review from inputs i left join firsts f on i.batch_id = f.batch_id and i.idx = f.idx and f.n = 1""",
    "response_warnings": _WARN.replace("{lines}", LINES),
    "correction_diff": f"""with {MIXED}, o as (select *, {_DIFF} from done where field_key = 'positions_designations' and raw <> ''),
        f as (select place, raw, arg_min(standardized_value, row_id) as original from o group by all),
        d as (select o.place, o.raw, original, proposed, row_number() over (partition by o.place, o.raw order by row_id) as n from o join f on o.place = f.place and o.raw = f.raw where proposed not in ('', original))
        select 'positions_designations' as field_key, raw as raw_value, place as country, original, proposed from d where n = 1""",
    "correction_diff_analytics": _DIFFS,
    "make_corrections": f"""with made as ({_DIFFS}) select sha256(concat_ws(chr(31), '2024-01-01T00:00:00+00:00', field_key, raw_value, country, proposed)) as id, '2024-01-01T00:00:00+00:00' as submitted_at,
        'someone' as submitted_by, country, raw_value, field_key, coalesce({mapped("field_key", {k: v[0] for k, v in FIELDS.items()})}, field_key) as field_display, original, proposed, 'user' as source from made""",
    "correction_queue": f"with {EVENTS} select * from queue",
    "correction_events": f"with {EVENTS} select * from queue",
    "queue_views": f"""with {EVENTS}, s as (select *, case id % 5 when 0 then 'demo' when 1 then 'user' end as source from queue)
        select 'pending' as view, id from s where status = 'pending' union all select 'history', id from s where status <> 'pending'
        union all select 'needs rule update', id from s where status = 'approved' and needs_prompt_update union all select 'without demo', id from s where source is distinct from 'demo'""",
    "correction_enqueue": f"""with {EVENTS}, waiting as (select field_key, raw_value, country from queue group by all having arg_max(status, id) = 'pending'),
        fresh as (select s.*, row_number() over (partition by field_key, raw_value, country order by id) as n from submissions s
            where not exists (select 1 from waiting q where q.field_key = s.field_key and q.raw_value = s.raw_value and q.country = s.country))
        select id, submitted_at, field_key, country, raw_value, proposed from fresh where n = 1""",
    "lookup_upsert": f"""with {BUILT}, {EVENTS},
        new as (select field_key, case when country <> '' then 'by_country' else 'consistent' end as tier, country, raw_value as raw, proposed as std,
                       row_number() over (partition by field_key, country, raw_value order by reviewed_at desc, id desc) as n from queue where status = 'approved')
        select l.field_key, l.tier, l.country, l.raw, l.std from lookup l where not exists (select 1 from new where new.field_key = l.field_key and new.tier = l.tier and new.country = l.country and new.raw = l.raw)
        union all select field_key, tier, country, raw, std from new where n = 1""",
    "truth_split": f"with {TRUTH} select field_key, count(*) as raw_values, count_if(n = 1) as consistent, count_if(n > 1) as ambiguous from labelled group by field_key",
    "accuracy": f"""with {TRUTH} select field_key, count(*) as scored, count_if(correct) as correct, count_if(not correct) as mismatches, round(count_if(correct) / count(*) * 100.0, 6) as accuracy
        from scores group by field_key""",
    "accuracy_by_confidence": f"""with {TRUTH} select case when sure then 'HIGH' else 'LOW' end as level, count_if(correct) as correct, count(*) as total, round(count_if(correct) / count(*) * 100.0, 6) as accuracy
        from scores group by sure""",
    "first_mismatches": f"with {TRUTH} select field_key, raw, expected, std as got from scores where not correct order by field_key, raw limit 12",
    "handoff_mapping": f"with {MIXED} select distinct raw as input, standardized_value as value, fieldType as type from done where raw <> ''",
    "handoff_countries": f"with {PLACED} select fieldType as field, string_agg(distinct trim(Country), ', ' order by trim(Country)) as countries from placed where trim(Country) <> '' group by fieldType",
    "handoff_fields": f"""with {KEYED} select field_key, regexp_replace({mapped("field_key", {k: v[0] for k, v in FIELDS.items()})}, ' *[(][A-Z]+[)] *$', '') as field_name,
        string_agg(distinct trim(fieldType), ', ' order by trim(fieldType)) as field_types, string_agg(distinct trim(Country), ', ' order by trim(Country)) filter (where trim(Country) <> '') as countries
        from keyed where field_key is not null group by field_key""",
    "batch_plan": f"with {PLAN} select field_key, country, raw, first_row, p // 25 + 1 as batch_no, p % 25 + 1 as item from plan",
    "batch_messages": f"""with {PLAN} select field_key, p // 25 + 1 as batch_no, cast(count(*) as int) as n_items, 'Classify the following ' || count(*) || ' entries:' || chr(10) || chr(10)
        || string_agg((p % 25 + 1) || '. ' || case when country = '' then raw else '[Country: ' || country || '] ' || raw end, chr(10) order by p) as message from plan group by field_key, p // 25 + 1""",
    "external_batches": f"""with {KEYED}, asked as (select *, {_client_label()} as hit from keyed)
        select countryId as countryid, fieldType as fieldtype, row_id, Country as country, inputText as inputtext,
               case when field_key is null then 'Unknown field type' when raw = '' then '{CATCH_ALL}' else coalesce(hit, '{CATCH_ALL}') end as standardized_value,
               case when field_key is null then {UNKNOWN} when raw = '' then 'Needs Review' when hit is not null then '' else 'Needs Review: ' || {OPTIONS} end as needs_review,
               case when field_key is null or raw = '' or hit is not null then '' else 'no rule fits' end as review_reason from asked""",
    "rules_positions_regional": _regional(),
    "rule_table_positions": _regional(),
    "quoted_round_trip": """select o_orderkey as row_id, 'a' || m || o_custkey || m || 'z' as value, '5" pipe' as size
        from (select *, ['"', '""', chr(10), '"' || chr(10) || '"', ',', chr(10) || chr(10) || ',', '",' || chr(10) || '"', ' '][o_orderkey % 8 + 1] as m from orders)""",
    "rule_table_labels": " union all ".join(f"select {text(k)} as field_key, * from ({rules_sql(k)})" for k in derived.RULE_VALUES if k in RULES),
    "compliance_flag": f"with {_rule_rows('positions_designations')} select row_id, raw from low where {any_within('t', ['liquidator', 'receiver', 'insolvency practitioner'])}",
    "rules_status": rules_sql("business_status"),
    "rules_do_status": rules_sql("directors_officers_status"),
    "rules_do_type": rules_sql("directors_officers_type"),
    "rules_entity_type": rules_sql("business_entity_type"),
    "rules_owner_type": rules_sql("ownership_relationship_type"),
    "rules_psc": rules_sql("psc_beneficiary_type"),
    "rules_brn": rules_sql("brn_type"),
    "rules_legal_form": rules_sql("business_legal_form"),
}
ORACLE_SQL = {name: whole_counts(sql) for name, sql in ORACLE_SQL.items()}
ORACLE_SQL |= {"queue_store": ORACLE_SQL["correction_queue"], "queue_submit": ORACLE_SQL["correction_enqueue"], "lookup_store": ORACLE_SQL["lookup_upsert"], "lookup_buckets": ORACLE_SQL["lookup_resolve"]}
