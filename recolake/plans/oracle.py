"""DuckDB twins of the canonical tables, for the SQL oracle.

Each oracle query references ``v_<name>`` views; ``with_views`` prepends the
needed definitions (and their dependencies) as CTEs so the statement runs on
the raw driver tables alone.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_interactions": """
        select o_custkey as user_id, l_partkey as item_id,
               cast(1 + floor((l_quantity - 1) / 10) as double) as rating,
               cast(l_shipdate as timestamp) as ts
        from lineitem join orders on l_orderkey = o_orderkey""",
    "v_item_stats": """
        select item_id, avg(rating) as average_rating, count(*) as rating_number
        from v_interactions group by item_id""",
    "v_items": """
        select p_partkey as item_id, p_name as title, p_type as main_category, p_brand as store,
               p_size as size, p_retailprice as price, s.average_rating, s.rating_number
        from part left join v_item_stats s on p_partkey = s.item_id""",
    "v_item_vectors": "select vec_id as item_id, embedding as model_factor from embeddings",
    "v_user_factors": "select vec_id as user_id, embedding as features from embeddings",
    "v_item_factors": "select vec_id as item_id, embedding as features from embeddings",
    "v_activity": """
        select event_id, cast(ts as timestamp) as ts, user_id,
               case event_type when 'view' then 'product_view' when 'click' then 'search'
                               when 'signup' then 'user_registration' else event_type end as event_type,
               cast(json_extract_string(props, '$.k') as bigint) as item_id, value
        from events where event_type <> 'error'""",
    "v_search_log": """
        select a.event_id, a.ts, a.user_id, lower(p.p_name) as query
        from v_activity a join part p on a.item_id = p.p_partkey
        where a.event_type = 'search'""",
    "v_requests": """
        select event_id, user_id,
               case event_type when 'search' then 'search' else 'recommendations' end as action, ts
        from v_activity where event_type in ('search', 'product_view')""",
    "v_key_inventory": """
        select concat('db', cast(event_id % 2 as varchar)) as db,
               concat(case event_type when 'view' then 'recs:' when 'click' then 'search:' else 'product:' end,
                      cast(event_id as varchar),
                      case when event_type = 'view' then case when event_id % 2 = 0 then ':cf' else ':hybrid' end
                           else '' end) as key,
               case when event_type = 'purchase' then 'zset' when event_type = 'error' then 'list'
                    else 'string' end as type,
               cast(floor(value * 100) as bigint) as size_bytes,
               cast(json_extract_string(props, '$.k') as bigint) * 1200 - 1 as ttl_s
        from events""",
    "v_customers": "select c_custkey as user_id from customer",
    "v_described": """
        select p_partkey as item_id, p_name as title, p_type as main_category, p_brand as store, d.text as description, c.features
        from part left join documents d on d.doc_id = p_partkey
        left join (select conv_id, string_agg(text, ' ' order by turn) as features from conversations group by conv_id) c
          on c.conv_id = p_partkey""",
    "v_described_lists": """
        select p_partkey as item_id, p_name as title, d.text as description, c.features
        from part left join documents d on d.doc_id = p_partkey
        left join (select conv_id, list(text order by turn) as features from conversations group by conv_id) c on c.conv_id = p_partkey""",
    "v_text_queries": """
        select query from v_search_queries
        union select array_to_string(t[1:2], ' ') from (
          select regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as t from documents
          where doc_id in (select item_id from v_activity where event_type = 'search'))
        where len(t) > 0""",
    "v_search_queries": """
        select distinct query from (
          select unnest([lower(p.p_name), p.p_type, p.p_brand]) as query
          from v_activity a join part p on a.item_id = p.p_partkey where a.event_type = 'search')""",
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def _deps(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in VIEWS]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every ``v_*`` view it uses, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in _deps(VIEWS[name]):
            if d != name:
                visit(d)
        order.append(name)

    for n in _deps(sql):
        if re.search(rf"\b{n} as \(", sql):
            continue  # already expanded
        visit(n)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    low = body.lower()
    if low.startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if low.startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
