"""SQL counterparts of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

# Greedy sizes: the longest piece at every place of every distinct word, then a walk from piece to piece.
SIZES = """v as (select distinct piece from tokenizer_vocab where kind = 'text' and piece <> ''),
 w as (select distinct '▁' || word as s from words where word <> ''),
 spots as (select s, unnest(range(1, length(s) + 1)) as pos from w),
 fits as (select s, pos, unnest(range(1, 1 + least(length(s) - pos + 1, (select max(length(piece)) from v)))) as l from spots),
 steps as (select f.s, f.pos, max(f.l) as step from fits f join v on v.piece = substring(f.s, f.pos, f.l) group by 1, 2),
 walk as (select s, 1::bigint as pos, 0::bigint as n from w union all select k.s, k.pos + coalesce(t.step, 1), k.n + 1 from walk k left join steps t on t.s = k.s and t.pos = k.pos where k.pos <= length(k.s)),
 size_of as (select s, max(n) as n from walk where pos > length(s) group by 1)"""

DOC_SIZES = rf"""with recursive words as (select doc_id as id, unnest(string_split_regex(text, '[ \t\n]+')) as word from documents where text is not null), {SIZES},
 d as (select doc_id, lower(trim(source)) as source, coalesce(t.n, 0) as n from documents left join (select id, sum(z.n) as n from words join size_of z on z.s = '▁' || word where word <> '' group by 1) t on t.id = doc_id)"""

CODES = "case regexp_extract(lower(x), '^\\s*([a-z]+)', 1) when 'ara' then 'ar' when 'arabic' then 'ar' when 'deu' then 'de' when 'ger' then 'de' when 'german' then 'de' when 'eng' then 'en' when 'english' then 'en' when 'spa' then 'es' when 'spanish' then 'es' when 'fra' then 'fr' when 'fre' then 'fr' when 'french' then 'fr' when 'ita' then 'it' when 'italian' then 'it' when 'nld' then 'nl' when 'dut' then 'nl' when 'dutch' then 'nl' when 'por' then 'pt' when 'portuguese' then 'pt' when 'und' then null when 'unknown' then null when '' then null else regexp_extract(lower(x), '^\\s*([a-z]+)', 1) end"

SLICES = rf"""with recursive words as (select rec_id as id, unnest(string_split_regex(ref, '[ \t\n]+')) as word from manifest where ref is not null), {SIZES},
 t as (select id, sum(z.n) as n from words join size_of z on z.s = '▁' || word where word <> '' group by 1),
 fam as (select rec_id, min(regexp_extract(lower(trim(source)), '^[a-z_]+', 0)) as source from samples where trim(source) <> '' group by 1),
 r as (select f.source, list_sort(list_distinct(list_filter(list_transform(string_split_regex(coalesce(m.lang, ''), '[+/]'), lambda x: {CODES}), lambda c: c is not null))) as ls, coalesce(lower(trim(m.domain)), 'unknown') as domain, coalesce(t.n, 0) as n
   from manifest m join fam f using (rec_id) left join t on t.id = m.rec_id),
 c as (select source, case when len(ls) = 0 then 'und' else array_to_string(ls, '+') end as lang, domain, sum(n) as n, count(*) as k from r group by 1, 2, 3)"""

P2 = f"{SLICES} select k.source, k.lang, k.domain from token_needs k left join c using (source, lang, domain) where coalesce(c.n, 0) * 1000.0::double < k.need_per_mille * (select sum(n) from c)"

P2_CUBE = f"{SLICES} select source, lang, domain, sum(k)::bigint as n_records, sum(n)::bigint as n_tokens from c group by cube (source, lang, domain)"

P6 = f"{DOC_SIZES} select container, doc_id from d join containers on n > capacity_tokens"

P6_HELD = f"""{DOC_SIZES} select container, sum(ceil(n / capacity_tokens::double))::bigint as n_pieces, sum(n)::bigint as n_tokens, 0::bigint as n_overfull, 0::bigint as n_twice from d, containers where n > 0 group by 1"""

P7 = f"""{DOC_SIZES}, s as (select source, sum(n) as n from d group by 1), m as (select x.mix_name, x.source, x.weight, x.max_repeats, coalesce(s.n, 0) as n, sum(x.weight) over (partition by mix_name) as w, sum(coalesce(s.n, 0)) over (partition by mix_name) as t
   from mixture_sources x left join s on s.source = lower(trim(x.source)))
 select mix_name, source from m where n * max_repeats < weight / w * t"""

SHINGLES = r"""l as (select rec_id, list_filter(string_split(regexp_replace(lower(ref), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') as w from manifest where ref is not null),
 k as (select rec_id, w from l where len(w) >= 15 and len(list_distinct(w)) >= 10),
 g as (select rec_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as x from k),
 n as (select rec_id, count(*) as n from g group by 1),
 o as (select a.rec_id as a, b.rec_id as b, count(*) as o from g a join g b on a.x = b.x and a.rec_id < b.rec_id group by 1, 2),
 likely as (select a as rec_id_a, b as rec_id_b from o join n p on p.rec_id = a join n q on q.rec_id = b where 2 * o >= greatest(p.n, q.n))"""

P4 = f"with {SHINGLES} select rec_id_a, rec_id_b from likely"

P5 = rf"""with {SHINGLES}, side as (select rec_id, case when lower(trim(split)) = 'train' then 't' when lower(trim(split)) in ('val', 'validation', 'dev', 'test') then 'e' end as side,
   nullif(lower(regexp_replace(regexp_replace(trim(image), '^.*[/\\]', ''), '(.)\.[^.]*$', '\1')), '') as name from manifest),
 p as (select rec_id_a, rec_id_b from likely union select least(a.rec_id, b.rec_id), greatest(a.rec_id, b.rec_id) from side a join side b on a.name = b.name and a.side = 'e' and b.side = 't')
 select p.rec_id_a, p.rec_id_b from p join side a on a.rec_id = rec_id_a join side b on b.rec_id = rec_id_b where a.side <> b.side"""

ORACLE = {"p2_found": P2, "p2_budget_cube": P2_CUBE, "p6_invariants": P6_HELD, "p4_found": P4, "p5_found": P5, "p6_found": P6, "p7_found": P7}
