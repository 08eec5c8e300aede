"""DuckDB SQL of the training-data queries that SQL can tell, over the same tables.

The statements state the rules plainly (all shingles, all windows) and are meant for
small tables.  Not here: 3, 5, 7, 8 and 9 (tables of sentences, tokenizers, a trained
model, an iterative layout), 6 (a row per byte string needs more memory than a small
machine has, even on the smallest tables), 11 (a tokenizer) and the pipeline.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return _WORDS.format(f"coalesce({text}, '')")


def lower_words(text: str) -> str:
    return words(f"translate({text}, '{_UPPER}', '{_LOWER}')")


def shingle_sets(w: str, n: int = 5) -> str:
    """Distinct n-word sequences of a list of words, ascending; the whole sequence where there are fewer words."""
    return f"""case when len({w}) = 0 then []::varchar[]
        else list_sort(list_distinct([array_to_string({w}[k : k + {n - 1}], ' ') for k in range(1, greatest(len({w}) - {n - 2}, 2))])) end"""


NEAR_DUPLICATES = f"""
with recursive sets as materialized (
    select doc_id, {shingle_sets("w")} as s from (select doc_id, {lower_words("text")} as w from documents)
), classes as materialized (
    select min(doc_id) as class_id, s, len(s) as n from sets where len(s) > 0 group by s
), grams as materialized (
    select class_id, n, unnest(s) as gram from classes
), pairs as (
    select a.class_id as x, b.class_id as y, a.n as nx, b.n as ny, count(*) as n_common
    from grams a join grams b on a.gram = b.gram and a.class_id < b.class_id group by all
), links as materialized (
    select x, y from pairs where 100 * n_common >= 75 * (nx + ny - n_common)
), either as materialized (
    select x, y from links union all select y, x from links
), reach(a, b) as (
    select class_id, class_id from classes
    union
    select r.a, e.y from reach r join either e on r.b = e.x
), component as (
    select a as class_id, min(b) as component_id from reach group by a
)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(c.component_id, d.doc_id) as component_id,
    coalesce(c.component_id, d.doc_id) = d.doc_id as kept, coalesce(k.class_id, d.doc_id) as class_id
from sets d left join classes k on len(d.s) > 0 and d.s = k.s left join component c on c.class_id = k.class_id
"""

QUALITY = rf"""
with docs as materialized (
    select doc_id, coalesce(text, '') as t, {words("text")} as w from documents
), at6 as materialized (
    select doc_id, k, array_to_string(w[k : k + 5], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 4)) as k from docs)
), at8 as materialized (
    select doc_id, k, array_to_string(w[k : k + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as k from docs)
), twice6 as materialized (
    select doc_id, k, g from (select *, count(*) over (partition by doc_id, g) as n from at6) where n > 1
), covered6 as (
    select doc_id, count(distinct k + j) as n from twice6, range(0, 6) r(j) group by doc_id
), covered8 as (
    select doc_id, count(distinct k + j) as n from (select *, count(*) over (partition by doc_id, g) as n from at8), range(0, 8) r(j) where n > 1 group by doc_id
), diagonals as (
    select a.doc_id, b.k - a.k as d, a.k - row_number() over (partition by a.doc_id, b.k - a.k order by a.k) as run
    from twice6 a join twice6 b on a.doc_id = b.doc_id and a.g = b.g and a.k < b.k
), longest as (
    select doc_id, max(n) + 5 as n from (select doc_id, count(*) as n from diagonals group by doc_id, d, run) group by doc_id
), counted as (
    select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(c8.n, 0)::bigint as n_repeat_words, coalesce(c6.n, 0)::bigint as n_covered, coalesce(l.n, 0)::bigint as longest_repeat
    from (select *, [x for x in str_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines from docs) d
    left join covered8 c8 using (doc_id) left join covered6 c6 using (doc_id) left join longest l using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * n_covered > 30 * n_words or (longest_repeat > 40 and 100 * longest_repeat > 25 * n_words)) as kept,
    n_covered, longest_repeat
from counted
"""

SUBSTRING = f"""
with docs as materialized (
    select doc_id, {words("text")} as w from documents
), windows as materialized (
    select doc_id, k, array_to_string(w[k : k + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as k from docs)
), later as materialized (
    select doc_id, k from (select *, row_number() over (partition by g order by doc_id, k) as nth from windows) where nth > 1
), each as (
    select doc_id, word, k, l.k is not null as starts
    from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from docs) left join later l using (doc_id, k)
), judged as (
    select *, bool_or(starts) over (partition by doc_id order by k rows between 19 preceding and current row) as gone from each
), told as (
    select doc_id, count(*) filter (gone) as n_removed, count(*) filter (starts) as n_windows,
        coalesce(string_agg(word, ' ' order by k) filter (not gone), '') as kept
    from judged group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_windows, 0)::bigint as n_windows,
    sha256(coalesce(kept, '')) as kept_sha256
from docs d left join told using (doc_id)
"""


CONTAINED = f"""
with docs as materialized (
    select doc_id, w, {shingle_sets("w")} as s from (select doc_id, {lower_words("text")} as w from documents)
), items as materialized (
    select item_id, w, {shingle_sets("w")} as s from (select item_id, {lower_words("text")} as w from benchmark where text is not null)
), wanted as (
    select item_id, len(s) as n, unnest(s) as gram from items where len(w) >= 5
), found as (
    select doc_id, item_id, count(*) as n_shared, n as n_item
    from (select doc_id, unnest(s) as gram from docs where len(w) >= 5) join wanted using (gram) group by doc_id, item_id, n
)
select doc_id, item_id, n_shared::bigint as n_shared, n_item::bigint as n_item, false as short_item from found where 100 * n_shared >= 75 * n_item
union all
select doc_id, item_id, 1::bigint, 1::bigint, true
from docs d join items i on len(i.w) between 1 and 4 and contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')
"""

_FINITE = "{0} is not null and len(list_filter({0}, lambda x: x is null or not isfinite(x))) = 0"


def _moved(r: int) -> str:
    """Round r of the clustering: every vector to its nearest centroid, every centroid with vectors to their floored mean."""
    return f"""
near{r} as materialized (
    select row_id, arg_min(c, (d, c)) as c, min(d) as d from (
        select e.row_id, m.c, sum((e.x - m.x) * (e.x - m.x))::bigint as d from comps e join means{r} m using (k) group by e.row_id, m.c) group by row_id
), means{r + 1} as materialized (
    select m.c, m.k, coalesce(n.x, m.x) as x from means{r} m
    left join (select c, k, floor(sum(x)::double / count(*))::bigint as x from comps join near{r} using (row_id) group by c, k) n on n.c = m.c and n.k = m.k
)"""


CENTROIDS = f"""
with kept as materialized (
    select row_number() over () as row_id, vec_id, [floor(64 * x::double)::bigint for x in embedding] as v
    from embeddings where len(embedding) = 64 and {_FINITE.format("embedding")}
), comps as materialized (
    select row_id, unnest(v) as x, unnest(range(1, 65)) as k from kept
), first as (
    select row_number() over (order by h) - 1 as c, v from (select v, sha256('1:' || vec_id) as h from kept where vec_id is not null order by h limit 16)
), means0 as materialized (
    select c, unnest(v) as x, unnest(range(1, 65)) as k from first
),{",".join(_moved(r) for r in range(4))},
told as (
    select c, sha256(array_to_string(list(x order by k), ',')) as sha from means3 group by c
)
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha as centroid_sha256
from near3 join kept using (row_id) join told using (c)
"""

HARD_NEGATIVES = f"""
with rows as materialized (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double)::bigint for x in embedding] as v
    from embeddings where vec_id is not null and label is not null and {_FINITE.format("embedding")}
), comps as materialized (
    select vec_id, label, unnest(v) as x, unnest(range(len(v))) as k from rows
), scores as materialized (
    select a.vec_id as a, b.vec_id as b, a.label = b.label as same, sum(a.x * b.x)::bigint as score
    from comps a join comps b on a.k = b.k and a.vec_id % 100 = 0 and a.vec_id <> b.vec_id group by a.vec_id, b.vec_id, a.label, b.label
), positives as (
    select a, b, score from (select *, row_number() over (partition by a order by score desc, b) as nth from scores where same) where nth <= 5
), found as (
    select p.a, p.b, p.score as ps, s.b as n, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as nth
    from positives p join scores s on s.a = p.a and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
)
select a as anchor_id, b as positive_id, nth::int as rank, n as negative_id, ps as positive_score, ns as negative_score from found where nth <= 5
"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": NEAR_DUPLICATES,
    "op2_suffix_array_quality_rules": QUALITY,
    "op4_recompression_substring_dedup": SUBSTRING,
    "op10_minhash_containment_decontamination": CONTAINED,
    "op12_laesa_centroids": CENTROIDS,
    "op13_segment_hard_negatives": HARD_NEGATIVES,
}
