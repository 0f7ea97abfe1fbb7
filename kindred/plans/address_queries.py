"""Queries over street addresses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions.address import APARTMENT, BOX, PREFIXES, STATES, SUFFIXES, UNITS, house_line, parsed_address, street_line, street_line_or_box
from kindred.plans.registry import query
from kindred.sources.bridge import ADDRESSES, CONTRIB, addresses

#: Ways in which a street address is written, around one of the table.
FORMS = [
    "{} APT 5", "{}", "N {}", "{}, SUITE 4, IL 62704", "(TOWER B) {} #3-A", "12-14 Old Mill Road", "Rose Hall {}", "{} - 2 units", "PO BOX 77", "455 Broadway", "7 West Oak Avenue, Texas",
    "{}, Springfield, IL", "St", "77", "", "9 Elm Ct, CT 06001", "1/2 S W Long Lake Dr.", "apartment 9, {}", "Lot 5 NE {} Rear", "100 rd", "Hill House 8 E River  Bend Unit 3",
]


def streets(spark, sf_dir):
    a = addresses(spark, sf_dir).where("CONTRIBUTOR_STREET_1 is not null").select("CONTRIBUTOR_STREET_1").distinct()
    forms = F.array(*[F.lit(f) for f in FORMS])
    return a.select("CONTRIBUTOR_STREET_1", F.explode(forms).alias("form")).select(F.replace("form", F.lit("{}"), F.col("CONTRIBUTOR_STREET_1")).alias("raw")).distinct()


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lookup(values: dict[str, str], x: str) -> str:
    return f"list_extract([{', '.join(_q(v) for v in values.values())}], list_position([{', '.join(_q(k) for k in values)}], {x}))"


FORM_OF = SUFFIXES | {v: v for v in SUFFIXES.values()}
CODE_OF = {k.upper(): v for k, v in STATES.items()} | {v: v for v in STATES.values()}


def _at(words: str, test: str) -> str:
    return f"nullif(list_position(list_transform({words}, lambda w: coalesce({test}, false)), true), 0)"


def _capital(x: str) -> str:
    return f"concat(upper(substr({x}, 1, 1)), lower(substr({x}, 2)))"


IS_SUFFIX, IS_STATE = f"{_lookup(FORM_OF, 'upper(w)')} is not null", f"{_lookup(CODE_OF, 'upper(w)')} is not null"
PARSE = f"""with {CONTRIB}, {ADDRESSES}, forms as (select unnest([{', '.join(map(_q, FORMS))}]) as form),
raws as (select distinct replace(form, '{{}}', CONTRIBUTOR_STREET_1) as raw from addresses, forms where CONTRIBUTOR_STREET_1 is not null),
a1 as (select raw, raw like '%,%' as commas, regexp_replace(replace(replace(translate(trim(raw), '.,', ''), '# ', '#'), ' & ', '&'), {_q(UNITS)}, '', 'gi') as t from raws),
a2 as (select raw, commas, nullif(regexp_extract(t, '\\((.*)\\)', 1), '') as inside, regexp_replace(t, '\\(.*\\)', '') as t from a1),
a3 as (select raw, commas, inside, list_extract(regexp_extract_all(t, {_q('(?i)' + APARTMENT)}), -1) as sure, list_reverse(list_filter(regexp_split_to_array(regexp_replace(t, {_q(APARTMENT)}, '', 'gi'), '\\s+'), lambda w: w<>'')) as ws from a2),
a4 as (select * exclude (ws), case when regexp_full_match(ws[1], '\\d{{5}}') then ws[1] end as zip, case when regexp_full_match(ws[1], '\\d{{5}}') then ws[2:] else ws end as ws from a3),
a5 as (select *, {_at('ws', IS_STATE)} as st, {_at('ws', f'{IS_SUFFIX} and not ({IS_STATE})')} as sf from a4),
a6 as (select * exclude (st, sf), case when commas and (sf is null or st<sf) then st end as st from a5),
a7 as (select * exclude (ws, st), {_lookup(CODE_OF, 'upper(ws[st])')} as state, case when st is null then ws else list_concat(ws[1:st-1], ws[st+1:]) end as ws from a6),
a8 as (select *, {_at('ws', f"({IS_SUFFIX}) or (regexp_matches(w, '^[A-Za-z]') and length(w)>2 and lower(w) not in ('apt','apartment'))")} as anchor from a7),
a9 as (select *, {_lookup(FORM_OF, 'upper(ws[anchor])')} as suf from a8),
b1 as (select *, anchor + case when suf is not null then 1 else 0 end as named from a9),
b2 as (select *, case when named<=len(ws) then ws[named+1:] else [] end as rest from b1),
b3 as (select *, {_at('rest', "regexp_matches(w, '^[0-9]')")} as h, {_at('rest', f"{_lookup(PREFIXES, 'lower(w)')} is not null")} as p from b2),
b4 as (select *, case when suf is not null then coalesce(least(h, p), len(rest)+1)-1 else 0 end as longer, coalesce(h, len(rest)+1) as hend from b3),
b5 as (select *, list_filter(list_transform(rest, lambda w, i: {{'w': w, 'i': i}}), lambda x: x.i is distinct from p and x.i is distinct from h and x.i>longer) as other from b4),
b6 as (select *, list_filter(list_concat(ws[1:coalesce(anchor-1, len(ws))], list_transform(list_filter(other, lambda x: x.i<hend), lambda x: x.w)), lambda w: regexp_matches(w, '^[#0-9A-Za-z_]')) as lo from b5),
parsed as (select raw, regexp_extract(rest[h], '^[^/-]*') as house, {_lookup(PREFIXES, 'lower(rest[p])')} as prefix,
 case when named<=len(ws) then array_to_string(list_reverse(list_transform(list_concat([ws[named]], rest[1:longer]), lambda w: {_capital('w')})), ' ') end as street,
 concat({_capital('suf')}, case when suf is not null then '.' end) as suffix, case when len(lo)>0 then lo[len(lo)] else sure end as apartment,
 nullif(concat_ws(' ', nullif(array_to_string(list_reverse(list_transform(list_filter(other, lambda x: x.i>hend), lambda x: x.w)), ' '), ''), inside), '') as building, cast(null as varchar) as city, state, zip from b6),
said as (select raw, nullif(house, '') as house, prefix, street, nullif(suffix, '') as suffix, apartment, building, city, state, zip from parsed)"""
LINE = "upper(concat_ws(' ', house, prefix, street, suffix))"


@query("address_parse", f"{PARSE} select * from said")
def address_parse(spark, sf_dir):
    return streets(spark, sf_dir).select("raw", parsed_address("raw").alias("p")).select("raw", "p.*")


@query("norm_street", f"{PARSE} select raw, {LINE} as line from said")
def norm_street(spark, sf_dir):
    return streets(spark, sf_dir).select("raw", street_line("raw").alias("line"))


@query("norm_street_ngram", f"{PARSE} select raw, case when raw='' or regexp_matches(raw, {_q('^(' + BOX + ')')}, 'i') or length({LINE})<5 then raw else {LINE} end as line from said")
def norm_street_ngram(spark, sf_dir):
    return streets(spark, sf_dir).select("raw", street_line_or_box(F.col("raw")).alias("line"))


@query("house_street", f"{PARSE} select raw, case when house is not null and street is not null then concat(house, ' ', upper(street)) end as line from said")
def house_street(spark, sf_dir):
    return streets(spark, sf_dir).select("raw", house_line("raw").alias("line"))
