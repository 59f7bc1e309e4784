"""SQL that gives the same rows as the queries of this subpackage, where SQL can say them over whole tables."""

from inkwright.operators.records import NORMAL_SQL, PAIRS_SQL

LIST_LABELS = f"""{PAIRS_SQL}, nf as (select record_id, {NORMAL_SQL.format('label')} as label, {NORMAL_SQL.format("coalesce(value, '')")} as value from raw),
rec as (select record_id, list_sort(list(label || chr(1) || value)) as fields from nf where value <> '' group by 1 having count(*) filter (label = 'field') > 0 and count(*) filter (label = 'en') > 0 and count(*) filter (label = 'zh') > 0),
grp as (select record_id, min(record_id) over (partition by fields) as kept_id from rec)"""

FILE_KEY = r"""nm as (select *, trim(regexp_replace(regexp_replace(replace(lower(upper(original_filename)), 'ς', 'σ'), '(%20|\+|_)', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'), ' ') as n from papers where id is not null and access_scope is not null and file_size is not null and original_filename is not null),
br as (select *, regexp_replace(regexp_replace(n, '(\s*\.\s*(pdf|ps|djvu|docx?|tex)|\s*[\s\-–]\s*(copy|kopie|copie)(\s*\(?\d{1,3}\)?)?|\s*\(\d{1,3}\)|\s*(的)?副本(\s*\(?\d{1,3}\)?)?)+$', ''), '^((copy|kopie|copie)( \(\d+\))? (of|von|de) )+', '') as bare from nm),
k as (select *, case when regexp_replace(bare, '[^\p{L}\p{N}]', '', 'g') = '' then regexp_replace(n, '\s', '', 'g') else regexp_replace(bare, '[^\p{L}\p{N}]', '', 'g') end as k from br),
m as (select *, min(id) over (partition by access_scope, file_size, k) as group_id, count(*) over (partition by access_scope, file_size, k) as rows from k),
t as (select *, case when updated_at is not null and updated_at < timestamp '2027-01-01' and not coalesce(updated_at < created_at, false) then epoch_us(updated_at) end as trusted from m where rows > 1),
fl as (select * from t where lower(trim(regexp_replace(coalesce(translated_filename, ''), '[\s\p{Z}]+', ' ', 'g'), ' ')) not in ('', 'n/a', 'na', 'null', 'none', 'nil', '-', '--', 'undefined', 'unknown', 'tbd', '?', 'nan')),
st as (select group_id, first(id order by trusted desc nulls last, id) as status_id, first(id order by created_at nulls last, id) as name_id from t group by 1), fi as (select group_id, first(id order by trusted desc nulls last, id) as file_id from fl group by 1)"""

WORDS = r"""list_filter(string_split_regex(lower(nfc_normalize(regexp_replace(text, '[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]', '', 'g'))), '[^\p{L}\p{N}]+'), lambda x: x <> '')"""

# sessions are taken in order; the list of accepted ones among those that resemble any goes from step to step
P1 = """with recursive h0 as (select *, regexp_replace(regexp_replace(lower(content_sha256), '^\\s*(sha-?256\\s*[:=]?\\s*|0x)', ''), '[^0-9a-z]', '', 'g') as hx from pdf_upload_sessions),
u as materialized (select id, coalesce(batch_no <= 0, true) as old, row_number() over (order by batch_no nulls first, created_at nulls first, id) as o, lower(trim(access_scope, ' ')) as scope,
  case when regexp_matches(hx, '^[0-9a-f]{64}$') and not regexp_matches(hx, '^0+$') then hx end as h, file_size, list_distinct(list_filter(chunk_digests, lambda x: x is not null)) as ds from h0),
d as materialized (select id, o, old, scope, len(ds) as n, unnest(ds) as x from u where scope is not null and len(ds) > 0),
c as (select a.o as late, b.o as early, any_value(a.n) as n, any_value(b.n) as m, count(*) as k from d a join d b on a.scope = b.scope and a.x = b.x and b.o < a.o where not a.old group by 1, 2),
e as materialized (select late, early from c where k * 5 >= (n + m - k) * 4 union select a.o, b.o from u a join u b on a.scope = b.scope and a.h = b.h and a.file_size = b.file_size and b.o < a.o where not a.old),
nb as materialized (select late, list(early) as ns, row_number() over (order by late) as k from e group by 1),
r(k, acc) as (select 0::bigint, (select coalesce(list(distinct early), []) from e where early not in (select late from e)) union all select nb.k, case when list_has_any(r.acc, nb.ns) then r.acc else list_append(r.acc, nb.late) end from r join nb on nb.k = r.k + 1),
fin as (select unnest(acc) as o from (select acc from r order by k desc limit 1))
select least(a.id, b.id) as upload_id_1, greatest(a.id, b.id) as upload_id_2 from e join u a on a.o = e.late join u b on b.o = e.early where e.early in (select o from fin) and e.late not in (select o from fin)"""

SQL = {
    "p1_found": P1,
    "p2_found": f"with {LIST_LABELS} select kept_id, record_id from grp where kept_id <> record_id",
    "p2_counts": f"with {LIST_LABELS} select kept_id, count(*) as copies from grp group by 1",
    "p5_found": f"with {FILE_KEY} select group_id, status_id, coalesce(file_id, '') as file_id, name_id from st left join fi using (group_id)",
    "p7_found": f"""with d as (select doc_id, {WORDS} as w from documents where doc_id is not null and text is not null), i as (select item_id, {WORDS} as w from eval_items where item_id is not null and text is not null),
dg as (select doc_id, array_to_string(w[s:s + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as s from d where len(w) >= 12)), ig as (select distinct item_id, array_to_string(w[s:s + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as s from i where len(w) >= 12))
select distinct doc_id, item_id from dg join ig using (g)""",
}
