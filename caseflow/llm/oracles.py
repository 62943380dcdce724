"""DuckDB SQL of the queries that SQL can express; plain definitions, without the operators' methods."""

#: Words covered by a window of 20 that also starts earlier; windows are numbered by the words they start at.
SUBSTRING_DEDUP = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
g as (select doc_id, pos, word, case when pos + 19 <= max(pos) over (partition by doc_id)
    then md5(array_to_string(list(word) over (partition by doc_id order by pos rows between current row and 19 following), ' ')) end as digest from w),
r as (select doc_id, pos, word, (digest is not null and row_number() over (partition by digest order by doc_id, pos) > 1)::int as again from g),
c as (select doc_id, pos, word, max(again) over (partition by doc_id order by pos rows between 19 preceding and current row) as gone from r),
k as (select doc_id, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by pos) filter (where gone = 0) as kept from c group by doc_id)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join k using (doc_id)"""

#: Inner products of floor(64 * x), exact in doubles.
EXACT_TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 20 = 0 and a.vec_id != b.vec_id and len(a.q) = len(b.q))
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 20"""

#: The exact nearest rows; squares are added in the order of the components. The search is approximate, but finds all of them in tables of some hundred vectors.
NEAREST = """with v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0),
s as (select a.vec_id as query_id, b.vec_id, sqrt(list_reduce(list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])), lambda x, y: x + y)) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id != b.vec_id and len(a.e) = len(b.e))
select query_id, row_number() over (partition by query_id order by score, vec_id)::int as rank, vec_id, score from s qualify rank <= 10"""


def _level(level: str, parents: list[str], weights: dict[str, int]) -> str:
    """The budgets of one level of the tree: children fill in order of capacity by weight, open ones share by weight, the rest by largest remainder."""
    here, up = ", ".join([*parents, level]), ", ".join(["root", *parents])
    named = " ".join(f"when {level} = '{k}' then {w}" for k, w in weights.items())
    weight = f"case {named} else 1 end" if named else "1"
    before = f"b_{parents[-1]}" if parents else "total"
    return f"""n_{level} as (select root, {here}, sum(cap)::bigint as capacity, {weight} as weight, any_value(budget) as budget from leaves join {before} using ({up}) group by root, {here}),
f_{level} as (select *, case when weight > 0 then capacity / weight else 0.0 end as fill from n_{level}),
l_{level} as (select *, (budget - coalesce(sum(case when weight > 0 then capacity else 0 end) over (partition by {up} order by fill, {level} rows between unbounded preceding and 1 preceding), 0))
  / nullif(sum(weight) over (partition by {up} order by fill, {level} rows between current row and unbounded following), 0) as level from f_{level}),
c_{level} as (select *, coalesce(level >= fill, true) as brim, max(case when not coalesce(level >= fill, true) then level end) over (partition by {up}) as shared from l_{level}),
s_{level} as (select *, shared is not null and not brim and weight > 0 as shares, shared * weight - floor(shared * weight) as part,
  least(case when weight <= 0 then 0 when shared is not null and not brim then floor(shared * weight) else capacity end, capacity)::bigint as share from c_{level}),
b_{level} as (select root, {here}, share + case when shares and row_number() over (partition by {up}, shares order by part desc, {level}) <= budget - sum(share) over (partition by {up}) then 1 else 0 end as budget from s_{level})"""


def mixing_sql(weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int, seed: str) -> str:
    """The mixture of ``documents`` with the domain as a checksum of the source."""
    levels, parents = [], []
    for level in ("domain", "lang", "source"):
        levels.append(_level(level, parents, weights.get(level, {})))
        parents.append(level)
    return rf"""with d as (select doc_id, coalesce('d' || (('0x' || substr(md5(source), 1, 1))::int % 4), chr(1) || 'null') as domain, coalesce(lang, chr(1) || 'null') as lang, coalesce(source, chr(1) || 'null') as source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n from documents),
leaves as (select 0 as root, domain, lang, source, sum(n)::bigint as tokens, (sum(n) * {max_epochs})::bigint as cap from d group by all),
total as (select 0 as root, floor(coalesce(sum(tokens), 0) * {budget_share})::bigint as budget from leaves),
{(","+chr(10)).join(levels)},
plan as (select domain, lang, source, case when tokens > 0 then least(budget // tokens, {max_epochs}) else {max_epochs} end::bigint as whole, budget - whole * tokens as spare from leaves join b_source using (root, domain, lang, source)),
o as (select doc_id, domain, lang, source, n, whole, spare, coalesce(sum(n) over (partition by domain, lang, source order by md5('{seed}:' || whole || ':' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
  from d join plan using (domain, lang, source)),
e as (select *, unnest(range(whole)) as epoch from o union all select *, whole as epoch from o where spare > 0 and ahead < spare)
select doc_id, nullif(domain, chr(1) || 'null') as domain, nullif(lang, chr(1) || 'null') as lang, nullif(source, chr(1) || 'null') as source, epoch::bigint as epoch, n as n_tokens from e"""


#: The mixture of op3: half of all tokens, at most two epochs of a leaf, weights of siblings.
MIXTURE = {
    "budget_share": 0.5,
    "max_epochs": 2,
    "seed": "mixture-1",
    "weights": {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}},
}

ORACLE_SQL = {"op1_substring_dedup": SUBSTRING_DEDUP, "op3_source_mixing": mixing_sql(**MIXTURE), "op4_exact_top_k": EXACT_TOP_K, "op7_nearest_neighbours": NEAREST}
