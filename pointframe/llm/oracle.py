"""The text operators that SQL can express as a whole, in DuckDB SQL."""

from __future__ import annotations

from pointframe.llm.licenses import BASE, templates
from pointframe.llm.urlrep import SECOND_LEVEL, STEPS


def _strength(groups: str, mean: str) -> str:
    return f"""(select coalesce(1 / greatest(0.005::double, least(0.9::double, (spread - (g - 1)) / nullif(n - n2 / n - (g - 1), 0))) - 1, 9.0::double)
    from (select sum(case when {mean} * (1 - {mean}) > 0 then n * pow(bad / n - {mean}, 2) / ({mean} * (1 - {mean})) else 0 end) as spread,
      count(*)::double as g, sum(n)::double as n, sum(n * n)::double as n2 from {groups} where n > 0))"""


def op9(rules: list[tuple[str, str]], z: float = 1.645, max_loss: float = 0.05) -> str:
    """SQL of the URL filter with its rules, longest first."""
    fits, verdicts = [], []
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        test = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')"
        fits.append(f"when {test} then '{text}'")
        verdicts.append(f"when {test} then '{kind}'")
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    return f"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
shown as (select page_id, host, try_cast(nullif(regexp_extract(path, '/(\\d{{1,18}})(?:\\.html)?/?\\z', 1), '') as bigint) as doc_id from parts),
counts as (
  select host, count(l.doc_id)::double as n, coalesce(sum(case when l.quality = 0 or l.toxic = 1 then 1 else 0 end) filter (where l.doc_id is not null), 0)::double as bad
  from shown left join labels l using (doc_id) group by host),
labelled as (select *, string_split(regexp_replace(host, ':\\d*\\z', ''), '.') as w from counts),
deep as (select *, len(w) >= 3 and length(w[-1]) = 2 and w[-2] in ({second}) as d from labelled),
base as (
  select host, n, bad, array_to_string(case when d then w[-3:] else w[-2:] end, '.') as domain, array_to_string(case when d then w[-2:] else w[-1:] end, '.') as suffix from deep),
whole as (select (sum(bad) + 0.5) / (sum(n) + 1) as mean0 from base),
suf as (select suffix, sum(n) as n, sum(bad) as bad, any_value(mean0) as mean0 from base, whole group by suffix),
suf1 as (select suffix, (bad + s * mean0) / (n + s) as mean1 from suf, (select {_strength("suf", "mean0")} as s)),
dom as (select domain, any_value(mean1) as mean1, sum(n) as n, sum(bad) as bad from base join suf1 using (suffix) group by domain),
dom1 as (select domain, (bad + s * mean1) / (n + s) as mean2 from dom, (select {_strength("dom", "mean1")} as s)),
hosts as (select host, n, bad, mean2 from base join dom1 using (domain)),
ab as (select host, n, bad, bad + s * mean2 as a, n - bad + s * (1 - mean2) as b from hosts, (select {_strength("hosts", "mean2")} as s)),
means as (select *, a / (a + b) as bad_rate from ab),
rates as (select host, n, bad, bad_rate, greatest(0, bad_rate - {z} * sqrt(bad_rate * (1 - bad_rate) / (a + b + 1))) as bad_low, bad_rate > mean0 as worse from means, whole),
steps as (select floor(bad_low * {STEPS}) as step, sum(n - bad) as good from rates where worse group by 1),
room as (select step, sum(good) over (order by step desc) as held from steps),
lim as (select coalesce(min(step), {2 * STEPS}) as step from room where held <= {max_loss} * (select sum(n - bad) from base) and (select sum(bad) from base) > 0)
select page_id, host, path, case {" ".join(fits)} end as rule,
  coalesce(case {" ".join(verdicts)} end, case when worse and floor(bad_low * {STEPS}) >= lim.step then 'block' else 'allow' end) as verdict,
  round(bad_rate, 9) as bad_rate, round(bad_low, 9) as bad_low
from parts join rates using (host), lim
"""


def op5(min_score: float = 0.75) -> str:
    """SQL of the licence scan: every template word votes for its alignment, without anchors."""
    known = templates()
    rows, keys = [], []
    for t, (label, key, text) in enumerate(known):
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        rows += [f"({t}, {i}, '{w}', {int(at <= i < at + len(phrase))})" for i, w in enumerate(words)]
        keys.append(f"({t}, '{label}', {len(phrase)}, {str(t < len(BASE)).lower()})")
    return f"""
with files as materialized (
  select row_number() over () as f, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from documents),
template(t, i, w, k) as materialized (values {", ".join(rows)}),
kind(t, label, len, base) as (values {", ".join(keys)}),
hits as materialized (select f, i, w from (select f, unnest(words) as w, unnest(range(len(words))) as i from files) where w in (select w from template)),
idf as (select v.w, ln(((select count(*) from files) + 1) / (coalesce(n, 0) + 1)) + 1 as idf
  from (select distinct w from template) v left join (select w, count(distinct f) as n from hits group by w) using (w)),
total as (select t, sum(idf) as total from template join idf using (w) group by t),
aligned as (
  select f, t, h.i - p.i as place, sum(idf / total) as score, sum(k) as held
  from hits h join template p using (w) join idf using (w) join total using (t) group by 1, 2, 3),
found as (select a.*, label, base from aligned a join kind using (t) where held = len and score >= {min_score} - 1e-9),
per as (
  select f, count(*) filter (where base) as n_base, min(place) filter (where base) as first_word, max(place) filter (where base) as last_word,
    string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, round(least(1.0::double, max(score)), 9) as score
  from found group by f)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from files left join per using (f)
"""
