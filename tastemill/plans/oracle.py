"""The queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

K, SEED, BATCH, DIM = 20, 42, 1000, 64

CTE = {
    "ix": """select event_id as ord, user_id, cast(json_extract_string(props, '$.k') as bigint) as item_id, ts,
        cast(least(floor(value), 255) as integer) as timespent, event_type = 'purchase' as "like", event_type = 'error' as dislike,
        event_type = 'signup' and event_id % 5 = 0 as share, event_type = 'view' and event_id % 7 = 0 as bookmark,
        event_type = 'click' and event_id % 3 = 0 as click_on_author, event_type = 'click' and event_id % 4 = 1 as open_comments,
        date_diff('day', date '2024-01-01', cast(ts as date)) // 7 as week from events""",
    "sc": """select *, coalesce("like" or share or bookmark or click_on_author or open_comments or timespent > 30, false) as pos,
        cast(case when dislike then 0 when "like" then 2 when share or bookmark or click_on_author or open_comments then greatest(1, least(timespent // 40, 2))
        else least(timespent // 40, 2) end as bigint) as score from ix""",
    "tr": "select * from sc where week between 0 and 3",
    "ho": "select * from sc where week = 4",
    "hp": "select distinct user_id, item_id from ho where pos",
    "big": """select o_custkey as user_id, l_partkey as item_id, l_quantity as timespent, l_returnflag = 'A' as "like",
        l_returnflag = 'R' and l_quantity < 5 as dislike from lineitem join orders on l_orderkey = o_orderkey""",
    "it": """select p_partkey as item_id, cast(substr(p_brand, 7) as bigint) as author_id, p_size as duration,
        row_number() over (order by coalesce(n, 0) desc, p_partkey) as rank
        from part left join (select item_id, count(*) as n from big group by 1) c on p_partkey = c.item_id""",
    "us": """select c_custkey as user_id, 18 + c_custkey % 60 as age, c_custkey % 2 as gender, c_nationkey as geo,
        row_number() over (order by coalesce(n, 0) desc, c_custkey) as rank
        from customer left join (select o_custkey, count(*) as n from orders group by 1) o on c_custkey = o_custkey""",
    "emb": "select vec_id as item_id, cast(any_value(embedding) as double[]) as e from embeddings group by 1",
    "unit": "select item_id, list_transform(e, lambda x: x / case when n = 0 then 1 else n end) as e from (select item_id, e, sqrt(list_dot_product(e, e)) as n from emb)",
    "top": f"""select row_number() over (order by n desc, w, item_id) as rank, item_id from (
        select item_id, count(*) as n, min(week) as w from tr where score >= 2 group by 1) order by n desc, w, item_id limit {K}""",
    "topk": "select rank, item_id, 1.0::double - case when (select count(*) from top) > 1 then 0.9::double * (rank - 1) / ((select count(*) from top) - 1) else 0 end as score from top",
    "recs": "select user_id, rank, item_id from (select distinct user_id from hp), topk",
    "um": f"""select user_id, coalesce(nh / np, 0) as precision, coalesce(nh / nt, 0) as recall, coalesce(ap / least({K}, nt), 0) as map,
        coalesce(dcg / list_sum(list_transform(range(1, least({K}, nt) + 1), lambda i: 1.0::double / log2(i + 1))), 0) as ndcg
        from (select user_id, count(*) as nt from hp group by 1) t left join (
            select user_id, count(*) as np, sum(hit)::double as nh, sum(hit * cum / place)::double as ap, sum(hit / log2(place + 1)) as dcg from (
                select *, sum(hit) over (partition by user_id order by rank) as cum, row_number() over (partition by user_id order by rank) as place from (
                    select r.user_id, r.rank, case when h.item_id is null then 0 else 1 end as hit from recs r left join hp h on r.user_id = h.user_id and r.item_id = h.item_id))
            group by 1) p using (user_id)""",
    "metrics": """select avg(precision) as precision, avg(recall) as recall, avg(map) as map, avg(ndcg) as ndcg, count(*) as n from um""",
    "wt": """select t.*, [-0.05::double, 1.0::double, 2.0::double, 3.0::double][t.score + 1] as w from sc t""",
    "bp": f"""select user_id, week < 4 as train, ord // {BATCH} as batch, pos, sum(w * x) / case when sum(abs(w)) = 0 then 1 else sum(abs(w)) end as b
        from (select user_id, week, ord, w, unnest(e) as x, unnest(range({DIM})) as pos from wt join emb using (item_id)) group by 1, 2, 3, 4""",
    "ema": """select user_id, pos, sum(0.05::double * pow(0.95::double, r - 1) * b) as x, max(r) as m, train from (
        select *, row_number() over (partition by user_id, train, pos order by batch desc) as r from bp) group by user_id, pos, train""",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """The body over the named common tables and what these use."""
    need, order = list(names), []
    uses = {"sc": ["ix"], "tr": ["sc"], "ho": ["sc"], "hp": ["ho"], "it": ["big"], "unit": ["emb"], "top": ["tr"], "topk": ["top"], "recs": ["hp", "topk"], "um": ["hp", "recs"], "metrics": ["um"], "wt": ["sc"], "bp": ["wt", "emb"], "ema": ["bp"]}

    def visit(n: str) -> None:
        for u in uses.get(n, []):
            visit(u)
        if n not in order:
            order.append(n)

    for n in need:
        visit(n)
    tables = ", ".join(f"{n} as ({CTE[n]})" for n in order)
    return f"with {'recursive ' if recursive else ''}{tables}{', ' if tables and not body.startswith('select') else ' '}{body}"


def _nearest(users: str, items: str) -> str:
    """Common tables rk from users (user_id, v) and items (item_id, e), both not normalised."""
    return f"""nu as (select user_id, list_transform(v, lambda x: x / case when n = 0 then 1 else n end) as v from (select user_id, v, sqrt(list_dot_product(v, v)) as n from ({users}))),
        ni as (select item_id, list_transform(e, lambda x: x / case when n = 0 then 1 else n end) as e from (select item_id, e, sqrt(list_dot_product(e, e)) as n from ({items}))),
        rk as (select user_id, item_id, score, row_number() over (partition by user_id order by round(score, 9) desc, item_id) as rank
               from (select user_id, item_id, list_dot_product(v, e) as score from nu, ni) qualify rank <= {K})"""


RANKED = "select user_id, rank, item_id, round(score, 6) as score from rk"
SUBSET = f"select item_id from (select distinct vec_id as item_id from embeddings) order by md5('{SEED}:' || item_id), item_id limit 200"
EMA_USERS = "select user_id, list(x order by pos) as v from ema where train group by 1"
DRAWS = f"""num as (select item_id, row_number() over (order by item_id) - 1 as number from own_items),
    dr as (select user_id, draw, ('0x' || substr(md5('{SEED}:' || user_id || ':' || draw), 1, 8))::bigint % (select count(*) from num) as number from own_users, (select unnest(range({8 * K})) as draw)),
    fi as (select user_id, number, min(draw) as draw from dr group by 1, 2),
    ra as (select user_id, number, row_number() over (partition by user_id order by draw) as rank from fi qualify rank <= {K})"""
def _cells(turns: int = 3) -> str:
    """The permuted grid cells of users who are short (positions with a, b and n): x and y after all turns."""
    cells = "select *, position // b as x, position % b as y from po"
    for turn in range(turns):
        for to, frm, size in (("x", "y", "a"), ("y", "x", "b")):
            cells = f"select * replace (({to} + ('0x' || substr(md5('{SEED}:{turn}{to}:' || user_id || ':' || {frm}), 1, 8))::bigint % {size}) % {size} as {to}) from ({cells})"
    return cells


UNSEEN = f"""kn as (select distinct user_id, number from tr join num using (item_id)),
    fr as (select user_id, number, draw from fi anti join kn using (user_id, number)),
    ct as (select user_id, coalesce(old, 0) as old, coalesce(fresh, 0) as fresh from own_users left join (select user_id, count(*) as old from kn group by 1) using (user_id)
           left join (select user_id, count(*) as fresh from fr group by 1) using (user_id)),
    gr as (select n, b, (n + b - 1) // b as a from (select n, floor(sqrt(n - 1))::bigint + 1 as b from (select count(*) as n from num))),
    po as (select user_id, a, b, n, unnest(range(least(old + {K} + a * b - n, a * b))) as position from ct, gr where fresh < least({K}, n - old)),
    mo as (select user_id, x * b + y as number, position + {8 * K} as draw from ({_cells()}) where x * b + y < n),
    un as (select user_id, number, min(draw) as draw from (from fr union all (select user_id, number, draw from mo anti join kn using (user_id, number))) group by 1, 2),
    ur as (select user_id, number from un qualify row_number() over (partition by user_id order by draw) <= {K})"""
USER_TOWER = f"select user_id, list_transform(range({DIM}), lambda j: [age::double, gender::double, geo::double, rank::double][(j % 4 + 1)::int] * 0.999::double) as v from us"
ITEM_TOWER = f"""select it.item_id, list_transform(range({DIM}), lambda j: (case when emb.e is null then [author_id::double, duration::double, rank::double][(j % 3 + 1)::int]
    else 0.5::double * [author_id::double, duration::double, rank::double][(j % 3 + 1)::int] + 0.5::double * emb.e[(j + 1)::int] end) * 0.999::double) as e from it left join emb using (item_id)"""
KMEANS = f"""pp as (select user_id, e as v, row_number() over (partition by user_id order by ord) as rn from tr join emb using (item_id) where pos),
    uu as (select distinct user_id from pp),
    st as (select user_id, 0::bigint as n, list_transform(range(4), lambda c: list_transform(range({DIM}), lambda j:
               (('0x' || substr(md5('{SEED}:' || user_id || ':' || c || ':' || j), 1, 8))::bigint / 4294967296.0::double - 0.5::double) * 0.2::double)) as c from uu
           union all
           select user_id, n + 1, list_transform(range(1, 5), lambda k: list_transform(range(1, {DIM + 1}), lambda j:
               (case when k = near then 0.85::double * c[k][j] + 0.15::double * v[j] else c[k][j] end) * 0.95::double))
           from (select st.user_id, st.n, st.c, p.v, list_position(list_transform(st.c, lambda x: list_distance(x, p.v)), list_min(list_transform(st.c, lambda x: list_distance(x, p.v)))) as near
                 from st join pp p on p.user_id = st.user_id and p.rn = st.n + 1)),
    fin as (select user_id, arg_max(c, n) as c from st group by 1)"""


def _long(table: str, key: str, v: str) -> str:
    return f"select {key}, unnest(range({DIM})) as pos, round(unnest({v}), 6) as value from {table}"


def _stats(source: str, by: str = "") -> str:
    return f"""select {by}count(*) as users, cast(sum(n) as bigint) as "rows", min(n) as min, quantile_cont(n, 0.25) as p25, quantile_cont(n, 0.5) as median, avg(n) as mean,
        quantile_cont(n, 0.75) as p75, max(n) as max from {source}"""


ORACLE: dict[str, str] = {
    "positive_filter": sql("select ord, user_id, item_id from sc where pos", "sc"),
    "feedback_score": sql("select ord, score from sc", "sc"),
    "signal_class": sql("select case when dislike then 'strong_negative' when pos then 'positive' when timespent < 1 then 'weak_negative' else 'neutral' end as signal, count(*) as n from sc group by 1", "sc"),
    "event_class": sql("select score, case when score >= 2 then 'positive' when score = 1 then 'neutral' else 'negative' end as event_class, count(*) as n from sc group by 1, 2", "sc"),
    "holdout_pairs": sql("select user_id, item_id from hp", "hp"),
    "holdout_sets": sql("select user_id, count(*) as n_items, min(item_id) as first_item, max(item_id) as last_item from hp group by 1", "hp"),
    "holdout_stats": sql("""select cast(sum(n) as bigint) as "rows", count(*) as users, count(*) filter (n > 1) as multi_row_users, min(i) as min, max(i) as max, round(avg(i), 6) as mean,
        round(quantile_cont(i, 0.5), 6) as median from (select user_id, count(*) as n, count(distinct item_id) as i from ho group by 1)""", "ho"),
    "holdout_last_positive": sql("select user_id, item_id from tr where score >= 2 qualify row_number() over (partition by user_id order by ts desc, ord desc) = 1", "tr"),
    "distinct_users": sql("select distinct user_id from ix", "ix"),
    "eval_user_cap": sql("select distinct user_id from hp order by user_id limit 50", "hp"),
    "popular_by_rank": sql("select rank, item_id from it", "it"),
    "popular_by_score": sql("select item_id, count(*) as n from tr where score >= 2 group by 1", "tr"),
    "popular_by_impressions": sql("select item_id, count(*) as n from big group by 1", "big"),
    "recommend_popular": sql("select c_custkey as user_id, rank, item_id, round(score, 6) as score from customer, topk", "topk"),
    "recommend_random": sql(f"own_items as (select p_partkey as item_id from part), own_users as (select c_custkey as user_id from customer), {DRAWS} select user_id, rank, item_id, round(1.0 / {K}, 6)::double as score from ra join num using (number)"),
    "hits_at_k": sql("select r.user_id, r.rank, r.item_id, case when h.item_id is null then 0 else 1 end::bigint as hit from recs r left join hp h on r.user_id = h.user_id and r.item_id = h.item_id", "recs", "hp"),
    "precision_recall_at_k": sql("select user_id, round(precision, 6) as precision, round(recall, 6) as recall from um", "um"),
    "map_at_k": sql("select user_id, round(map, 6) as value from um", "um"),
    "ndcg_at_k": sql("select user_id, round(ndcg, 6) as value from um", "um"),
    "coverage_at_k": sql("select round(count(distinct item_id)::double / (select count(*) from part), 6) as coverage from recs", "recs"),
    "evaluate_popular": sql("select round(precision, 6) as precision, round(recall, 6) as recall, round(map, 6) as map, round(ndcg, 6) as ndcg, round((select count(distinct item_id)::double from recs) / (select count(*) from part), 6) as coverage, n as n_eval_users from metrics", "metrics"),
    "vector_norms": sql("select item_id, round(sqrt(list_dot_product(e, e)), 6) as norm from emb", "emb"),
    "cosine_pairs": sql("select x.item_id as a, y.item_id as b, round(list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))), 6) as cosine from emb x join emb y on y.item_id = x.item_id + 1", "emb"),
    "embedding_duplicates": 'select count(*) as "rows", count(distinct vec_id) as unique_ids, count(*) - count(distinct vec_id) as duplicates from embeddings',
    "interactions_with_embedding": sql("select count(emb.item_id) as n_matched, count(*) - count(emb.item_id) as n_unmatched from big left join emb using (item_id)", "big", "emb"),
    "item_subset": f"select p_partkey as item_id from part order by md5('{SEED}:' || p_partkey), p_partkey limit 200",
    "user_batch_profile": sql("select user_id, batch, pos, round(b, 6) as value from bp where train", "bp"),
    "ema_user_embedding": sql("select user_id, pos, round(x, 6) as value from ema where train", "ema"),
    "ema_incremental": sql("select user_id, pos, round(coalesce(a.x * pow(0.95::double, coalesce(b.m, 0)), 0) + coalesce(b.x, 0), 6) as value from (select * from ema where train) a full join (select * from ema where not train) b using (user_id, pos)", "ema"),
    "recommend_ema": sql(_nearest(EMA_USERS, "select item_id, e from emb") + " " + RANKED, "ema", "emb"),
    "user_tower": sql(_long(f"({USER_TOWER})", "user_id", "v"), "us"),
    "item_tower": sql(_long(f"({ITEM_TOWER})", "item_id", "e"), "it", "emb"),
    "recommend_two_tower": sql(_nearest(USER_TOWER, ITEM_TOWER) + " " + RANKED, "us", "it", "emb"),
    "kmeans_centers": sql(KMEANS + " " + _long("(select user_id, unnest(range(4)) as center, unnest(c) as v from fin)", "user_id, center", "v"), "tr", "emb", recursive=True),
    "kmeans_export_mean": sql(KMEANS + " " + _long(f"(select user_id, list_transform(range(1, {DIM + 1}), lambda j: (c[1][j] + c[2][j] + c[3][j] + c[4][j]) / 4) as v from fin)", "user_id", "v"), "tr", "emb", recursive=True),
    "recommend_kmeans": sql(KMEANS + f""", cu as (select user_id, unnest(c) as v from fin), nu as (select user_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from cu),
        be as (select user_id, item_id, max(list_dot_product(v, unit.e)) as score from nu, unit group by 1, 2),
        rk as (select *, row_number() over (partition by user_id order by round(score, 9) desc, item_id) as rank from be qualify rank <= {K}) """ + RANKED, "tr", "emb", "unit", recursive=True),
    "lightgcn_degree": sql("ed as (select distinct user_id, item_id from tr where pos) select 'user' as side, user_id as id, count(*) as degree from ed group by 2 union all select 'item', item_id, count(*) from ed group by 2", "tr"),
    "lightgcn_propagate": sql(f"""ed as (select distinct user_id, item_id from tr where pos), du as (select user_id, count(*) as du from ed group by 1), di as (select item_id, count(*) as di from ed group by 1)
        select user_id, pos, round(sum(x / sqrt(du * di)), 6) as value from (select user_id, du, di, unnest(e) as x, unnest(range({DIM})) as pos from ed join du using (user_id) join di using (item_id) join emb using (item_id)) group by 1, 2""", "tr", "emb"),
    "negative_candidates": sql(f"own_items as (select distinct item_id from tr), own_users as (select distinct user_id from tr), {DRAWS}, {UNSEEN} select user_id, item_id from ur join num using (number)", "tr"),
    "user_sequences": sql("select user_id, count(*) as n, first(item_id order by ord) as first_item, last(item_id order by ord) as last_item, md5(string_agg(item_id::varchar, ',' order by ord)) as seq_md5 from tr group by 1", "tr"),
    "rows_per_user": sql("select user_id, count(*) as n from big group by 1", "big"),
    "user_distribution": sql("select users, \"rows\", min, round(p25, 6) as p25, round(median, 6) as median, round(mean, 6) as mean, round(p75, 6) as p75, max from (" + _stats("(select user_id, count(*) as n from big group by 1)") + ")", "big"),
    "per_week_avg_distribution": sql("select " + ", ".join(f'round(sum("{c}") / 5.0::double, 6) as "{c}"' for c in ("users", "rows", "min", "p25", "median", "mean", "p75", "max")) + " from (" + _stats("(select week, user_id, count(*) as n from ix group by 1, 2) group by week", "week, ") + ")", "ix"),
    "user_quantiles": sql("""pu as (select user_id, count(*) as n, count(*) filter ("like" or timespent > 30) as p from big group by 1), qs as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::double[]) as q)
        select q, round((select quantile_cont(n, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) from pu)[i], 6) as interactions, round((select quantile_cont(p, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) from pu)[i], 6) as positives,
        round((select quantile_cont(p / n, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) from pu)[i], 6) as positive_ratio from (select q, row_number() over (order by q) as i from qs)""", "big"),
    "weekly_profile": sql('select week, count(*) as "rows", count(*) filter (pos) as positives, round(count(*) filter (pos) / count(*), 6) as positive_rate, count(distinct user_id) as users, count(distinct item_id) as items from sc group by 1', "sc"),
    "profile_rollup": sql('select week, count(*) as "rows", count(*) filter (pos) as positives, round(count(*) filter (pos) / count(*), 6) as positive_rate from sc group by rollup(week)', "sc"),
    "null_profile": sql("""select unnest(['user_id', 'item_id', 'timespent', 'like']) as column_name, unnest([round(count(*) filter (user_id is null) / count(*), 6), round(count(*) filter (item_id is null) / count(*), 6),
        round(count(*) filter (nullif(timespent, 0) is null) / count(*), 6), round(count(*) filter ("like" is null) / count(*), 6)]) as null_fraction from ix""", "ix"),
    "count_distinct_items": sql("select (select count(distinct item_id) + max(case when item_id is null then 1 else 0 end) from ix)::bigint as in_interactions, (select count(distinct vec_id) from embeddings) as in_embeddings", "ix"),
    "interaction_share": sql("select round(avg(case when h.item_id is null then 0.0 else 1.0 end), 6)::double as share from recs r left join (select distinct user_id, item_id from ho) h on r.user_id = h.user_id and r.item_id = h.item_id", "recs", "ho"),
    "holdout_sample": sql("""select user_id, count(*) as n_items, array_to_string(list(item_id order by item_id)[1:8], ',') as items from hp
        where user_id in (select distinct user_id from hp order by user_id limit 3) group by 1""", "hp"),
    "holdout_merged": sql("select distinct user_id, item_id from sc where pos and week in (3, 4)", "sc"),
    "files_profile": sql("""pf as (select week, count(*) as n, count(*) filter (pos) as p, count(*) filter (pos) / count(*) as r from sc group by 1)
        select count(*) as files, sum(n)::bigint as "rows", sum(p)::bigint as positives, min(n)::double as rows_min, median(n) as rows_median, max(n)::double as rows_max,
        round(min(r), 6) as positive_rate_min, round(median(r), 6) as positive_rate_median, round(max(r), 6) as positive_rate_max from pf""", "sc"),
    "embedding_nan_fraction": sql(f"select round(sum(case when item_id % 5 = 0 then {-(-DIM // 7)} else 0 end)::double / (count(*) * {DIM}), 6) as nan_fraction from emb", "emb"),
    "affinity_scores": sql("""cp as (select x.item_id as a, y.item_id as b, 3 * round(list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))), 6) as c from emb x join emb y on y.item_id = x.item_id + 1)
        select a, b, case when c < -0.2 then 0 when c < 0.2 then 1 when c < 0.55 then 2 else 3 end::bigint as score from cp""", "emb"),
    "batches_of_files": f"select file, batch, count(*) as n from (select (row_number() over () - 1) // {BATCH} as batch from events), (select unnest([0, 1])::bigint as file) group by 1, 2",
    "core_popular": sql("""select user_id, rank, item_id, round(1.0::double - 0.9::double * (rank - 1) / ((select count(*) from it) - 1), 6) as score
        from (select distinct user_id from hp order by user_id limit 3), it""", "hp", "it"),
    "dsl_not_equal": sql('select user_id, count(*) as n from ix where item_id <> 7 and not "like" group by 1', "ix"),
    "dsl_filter_or": sql('select user_id, count(*) as n from ix where timespent > 20 or "like" or share or bookmark or click_on_author or open_comments group by 1', "ix"),
    "dsl_filter_and": sql('select user_id, count(*) as n from ix where timespent > 20 and not "like" and user_id is not null group by 1', "ix"),
    "dsl_not_in": sql("select user_id, count(*) as n from ix where item_id is null or item_id not in (1, 2, 3) group by 1", "ix"),
}
for _mode in ("bruteforce_full", "bruteforce_subset", "ann_full", "ann_subset"):
    _items = "select item_id, e from emb" + (f" where item_id in ({SUBSET})" if _mode.endswith("subset") else "")
    ORACLE[f"retrieve_{_mode}"] = sql(_nearest("select item_id as user_id, e as v from emb", _items) + " " + RANKED, "emb")
ORACLE["evaluate_ema"] = sql(
    _nearest(EMA_USERS, "select item_id, e from emb")
    + ", recs as (select user_id, rank, item_id from rk where user_id in (select user_id from hp)), um as (" + CTE["um"] + "), metrics as (" + CTE["metrics"] + ") "
    "select round(precision, 6) as precision, round(recall, 6) as recall, round(map, 6) as map, round(ndcg, 6) as ndcg, round((select count(distinct item_id)::double from recs) / (select count(*) from emb), 6) as coverage, n as n_eval_users from metrics",
    "ema", "emb", "hp",
)
