"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

#: The CRC-32 table as SQL: one row, its 256 states in `t`.
_CRC_TABLE = """crc as materialized (select list(list_reduce(list_prepend(b, range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by b) t from range(256) r(b))"""


def _crc(data: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {data}), lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8)))"


def _bytes(text: str) -> str:
    return f"list_transform(range(length(hex({text})) // 2), lambda i: ('0x' || substr(hex({text}), (2 * i + 1)::bigint, 2))::bigint)"


def _digest(text: str) -> str:
    said = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in said) + ")"


#: The levels of all sources' trees, then of the tree over their subroots; proofs by level; each leaf folded upwards.
OP11 = f"""
with recursive {_CRC_TABLE},
leaves as (
  select row_number() over () row, doc_id, coalesce('=' || source, '-') tree, {_digest('text')} leaf,
    {_digest("replace(text, chr(10), '')")} other,
    doc_id is not null and {_crc(_bytes("coalesce(doc_id::varchar, '')"))} % 2 = 0 tampered
  from documents, crc),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by tree) n from leaves),
low as (
  select tree, 0 height, idx, n, leaf node from placed
  union all
  select tree, height + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' order by idx)) from low where n > 1 group by tree, height, idx // 3, n),
subs as (select tree, node subroot, height top, row_number() over (order by tree) - 1 idx, count(*) over () n from low where n = 1),
high as (
  select 0 height, idx, n, subroot node from subs
  union all
  select height + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' order by idx)) from high where n > 1 group by height, idx // 3, n),
nodes as (select tree, height, idx, node from low union all select null, height, idx, node from high),
steps as (
  select row, tree, height, p.idx // (3 ** height)::bigint idx from placed p join (select distinct height, tree from low where n > 1) l using (tree)
  union all
  select row, null, h.height + top, s.idx // (3 ** h.height)::bigint from placed p join subs s using (tree) join (select distinct height from high where n > 1) h on true),
sides as (
  select s.row, s.height, coalesce(string_agg(node, '' order by k.idx) filter (where k.idx < s.idx), '') lefts, coalesce(string_agg(node, '' order by k.idx) filter (where k.idx > s.idx), '') rights
  from steps s join placed p using (row) join subs u on u.tree = p.tree
    join nodes k on k.tree is not distinct from s.tree and k.height = s.height - case when s.tree is null then u.top else 0 end and k.idx // 3 = s.idx // 3
  group by s.row, s.height),
proofs as (select row, sha256(string_agg(lefts || rights, '' order by height)) proof_sha256, list({{'l': lefts, 'r': rights}} order by height) path from sides group by row),
walk as (
  select row, 0 height, case when tampered then other else leaf end own from placed
  union all
  select w.row, w.height + 1, sha256(path[w.height + 1].l || own || path[w.height + 1].r) from walk w join proofs p on p.row = w.row and w.height < len(path)),
ends as (select row, arg_max(own, height) folded_root from walk group by row)
select doc_id, leaf, subroot, (select node from high where n = 1) root, coalesce(proof_sha256, sha256('')) proof_sha256, folded_root, folded_root = (select node from high where n = 1) verified
from placed join subs using (tree) left join proofs using (row) join ends using (row)
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x{{0}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"

OP12 = f"""
with {_CRC_TABLE},
texts as (select row_number() over () row, doc_id, {_WORDS} w from documents),
runs as materialized (select row, unnest({_RUNS}) f from texts),
aims as materialized (select unnest({_RUNS}) f from (select {_WORDS} w from benchmark)),
buckets as materialized (select f, {_crc(_bytes('f'))} % 10000 bucket from (select f from runs union select f from aims), crc),
own as materialized (select bucket, count(*) s from runs join buckets using (f) group by bucket),
aim as materialized (select bucket, count(*) t from aims join buckets using (f) group by bucket),
gains as materialized (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from own) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from aim) + 10000)::double)))::bigint gain
  from own left join aim using (bucket)),
means as (select row, floor(sum(gain)::double / count(*))::bigint weight from runs join buckets using (f) join gains using (bucket) group by row),
scored as (
  select row, doc_id, greatest(2 * len(w) - 1, 0)::bigint n_features, coalesce(weight, 0) weight, len(w) >= 20 fit,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint score
  from texts left join means using (row)),
ranked as (select *, row_number() over (partition by fit order by score desc, doc_id nulls first, n_features, weight) k, (25 * count(*) over (partition by fit)) // 100 drawn from scored)
select doc_id, n_features, weight, score, case when fit and k <= drawn then k end rank from ranked
"""


#: Windows are grouped by the MD5 of their 50 words.
OP13 = """
with texts as materialized (select row_number() over () row, doc_id, coalesce(doc_id::hugeint, 9223372036854775808::hugeint) own, regexp_extract_all(coalesce(text, ''), '[^\\x{20}\\x{09}-\\x{0D}]+') w from documents),
windows as materialized (select row, own, p, md5(array_to_string(w[p : p + 49], ' ')) h from (select row, own, w, unnest(range(1, len(w) - 48)) p from texts where len(w) >= 50)),
firsts as (select h, min(own) first_own from windows group by h),
later as (select row, p, lead(p) over (partition by row order by p) following from windows join firsts using (h) where own > first_own),
cut as materialized (select row, unnest(range(p, least(p + 50, coalesce(following, p + 50)))) k from later),
gone as (select row, count(*) n from cut group by row),
words as (select row, k, w[k] word from (select row, w, unnest(range(1, len(w) + 1)) k from texts)),
kept as (select row, string_agg(word, ' ' order by k) kept from words anti join cut using (row, k) group by row)
select doc_id, len(w) n_words, coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from texts left join gone using (row) left join kept using (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": OP11, "op12_importance_resampling": OP12, "op13_window_dedup": OP13}
