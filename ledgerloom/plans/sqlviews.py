"""SQL twins of the derived views, as common table expressions."""

from __future__ import annotations

from ..operators.transfers import TRANSFER_TOPIC
from .views import OTHER_TOPIC, SELECTOR_ORDER


def hexes(value: str, width: int) -> str:
    return f"'0x' || lpad(lower(to_hex(CAST({value} AS BIGINT))), {width}, '0')"


def addr(value: str) -> str:
    return hexes(value, 40)


def word(value: str) -> str:
    return hexes(value, 64)


def epoch(col: str) -> str:
    return f"CAST(floor(epoch({col})) AS BIGINT)"


def cents(col: str) -> str:
    return f"CAST(round({col} * 100) AS BIGINT)"


_LINE_ORDER = "l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_shipdate"

_CODE = "'0x6060604052' || " + " || ".join(
    f"CASE WHEN (part // {1 << i}) % 3 <> 1 THEN '8063{s}1461007857' ELSE '' END"
    for i, s in enumerate(SELECTOR_ORDER)
) + " || '6463deadbeef5b63cafebabe'"

# name -> (views it needs, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "edges": ([], f"""
        SELECT event_id AS edge_id, user_id AS src, user_id // 50 * 50 + (user_id * 7 + event_id * 13) % 50 AS dst,
               {epoch('ts')} AS t, value, event_type AS edge_type FROM events"""),
    "flows": ([], f"""
        SELECT o_orderkey AS edge_id, o_custkey AS src, (o_custkey * 7 + o_orderkey * 13) // 11 AS dst,
               {epoch('o_orderdate')} AS t, {cents('o_totalprice')} AS cents, o_totalprice AS value,
               o_orderpriority AS priority, o_orderstatus AS status FROM orders"""),
    "circles": ([], f"""
        SELECT o_orderkey AS edge_id, o_custkey AS src,
               o_custkey // 8 * 8 + (o_custkey * 7 + o_orderkey * 13) % 8 AS dst,
               {epoch('o_orderdate')} AS t, o_totalprice AS value, o_orderpriority AS period
        FROM orders"""),
    "flow_labels": (["flows"], """
        SELECT node_id, max(label) AS label FROM (
            SELECT src AS node_id, CAST(value > 450000 AS INTEGER) AS label FROM flows
            UNION ALL SELECT dst, CAST(value > 450000 AS INTEGER) FROM flows) GROUP BY node_id"""),
    "fraud_edges": (["flows", "flow_labels"], """
        SELECT f.* FROM flows f JOIN flow_labels a ON a.node_id = f.src AND a.label = 1
        JOIN flow_labels b ON b.node_id = f.dst AND b.label = 1"""),
    # Smallest reachable node per fraud node; every row of the recursion is a better label.
    "components": (["fraud_edges"], """
        SELECT id AS node_id, comp AS component FROM (
            WITH RECURSIVE links AS (
                SELECT src AS a, dst AS b FROM fraud_edges UNION SELECT dst, src FROM fraud_edges),
            cc(id, comp) USING KEY (id) AS (
                SELECT DISTINCT a AS id, a AS comp FROM links
                UNION
                SELECT l.b, min(cc.comp) FROM cc JOIN links l ON l.a = cc.id
                JOIN recurring.cc AS known ON known.id = l.b
                WHERE cc.comp < known.comp GROUP BY l.b)
            SELECT id, comp FROM cc)"""),
    "ring_members": (["components"], """
        SELECT component AS ring_id, node_id FROM components
        WHERE component IN (SELECT component FROM components GROUP BY component HAVING count(*) >= 2)"""),
    "rings": (["ring_members", "fraud_edges"], """
        SELECT m.ring_id, m.num_members, p.start_time, p.completion_time, p.num_edges FROM
            (SELECT ring_id, count(*) AS num_members FROM ring_members GROUP BY ring_id) m
        JOIN (SELECT r.ring_id, min(t) AS start_time, max(t) AS completion_time, count(*) AS num_edges FROM
                (SELECT src, dst, max(t) AS t FROM fraud_edges GROUP BY src, dst) e
              JOIN ring_members r ON r.node_id = e.src GROUP BY r.ring_id) p USING (ring_id)"""),
    "reach": (["circles"], """
        SELECT a, b FROM (
            WITH RECURSIVE r(a, b) AS (
                SELECT src, dst FROM circles WHERE src <> dst
                UNION SELECT r.a, c.dst FROM r JOIN circles c ON c.src = r.b)
            SELECT a, b FROM r)"""),
    "strong": (["reach"], """
        SELECT x.a AS node_id, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a
        GROUP BY x.a HAVING count(*) > 1"""),
    "densities": (["strong", "circles"], """
        SELECT s.component, s.size, e.edges, e.edges / CAST(s.size * (s.size - 1) AS DOUBLE) AS density FROM
            (SELECT component, count(*) AS size FROM strong GROUP BY component) s
        JOIN (SELECT a.component, count(*) AS edges FROM (SELECT DISTINCT src, dst FROM circles) c
              JOIN strong a ON a.node_id = c.src JOIN strong b ON b.node_id = c.dst
              WHERE a.component = b.component GROUP BY a.component) e USING (component)"""),
    # Two hops against the edge direction from every payer.
    "seeds": (["circles"], """
        SELECT DISTINCT src AS node_id FROM circles"""),
    "hood": (["seeds", "circles"], """
        SELECT node_id AS seed, node_id FROM seeds
        UNION SELECT s.node_id, c.src FROM seeds s JOIN circles c ON c.dst = s.node_id
        UNION SELECT s.node_id, d.src FROM seeds s JOIN circles c ON c.dst = s.node_id JOIN circles d ON d.dst = c.src"""),
    "hood_edges": (["hood", "circles"], """
        SELECT a.seed, c.* FROM circles c JOIN hood a ON a.node_id = c.src
        JOIN hood b ON b.seed = a.seed AND b.node_id = c.dst"""),
    "kept": (["hood", "hood_edges"], """
        SELECT seed FROM hood GROUP BY seed HAVING count(*) >= 3
        INTERSECT SELECT seed FROM hood_edges GROUP BY seed HAVING count(*) >= 2"""),
    "sub_nodes": (["hood", "kept"], "SELECT * FROM hood WHERE seed IN (SELECT seed FROM kept)"),
    "sub_edges": (["hood_edges", "kept"], "SELECT * FROM hood_edges WHERE seed IN (SELECT seed FROM kept)"),
    "anchor_points": (["sub_nodes", "sub_edges"], """
        SELECT seed, node_id AS anchor, slot FROM (
            SELECT n.seed, n.node_id, row_number() OVER (PARTITION BY n.seed ORDER BY coalesce(d.deg, 0) DESC, n.node_id) - 1 AS slot
            FROM sub_nodes n LEFT JOIN (
                SELECT seed, v, count(*) AS deg FROM (
                    SELECT seed, unnest([a, b]) AS v FROM (
                        SELECT DISTINCT seed, least(src, dst) AS a, greatest(src, dst) AS b FROM sub_edges))
                GROUP BY seed, v) d ON d.seed = n.seed AND d.v = n.node_id) WHERE slot < 16"""),
    "distances": (["anchor_points", "sub_edges", "sub_nodes"], """
        SELECT seed, anchor, node_id, min(dist) AS dist FROM (
            WITH RECURSIVE und AS (
                SELECT seed, src AS x, dst AS y FROM sub_edges UNION SELECT seed, dst, src FROM sub_edges),
            bfs(seed, anchor, node_id, dist) AS (
                SELECT seed, anchor, anchor, 0 FROM anchor_points
                UNION SELECT b.seed, b.anchor, u.y, b.dist + 1 FROM bfs b JOIN und u ON u.seed = b.seed AND u.x = b.node_id
                WHERE b.dist < 9)
            SELECT * FROM bfs) GROUP BY seed, anchor, node_id"""),
    "lines": ([], f"""
        SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LINE_ORDER}) AS n,
               l_partkey AS part, l_suppkey AS supp, {cents('l_extendedprice')} AS cents, CAST(l_quantity AS BIGINT) AS qty,
               l_returnflag AS flag FROM lineitem"""),
    "blocks": ([], f"""
        SELECT o_orderkey AS number, {word('o_orderkey + 1000000')} AS hash,
               {word('o_orderkey + 999999')} AS parent_hash, {addr('o_custkey')} AS miner,
               {epoch('o_orderdate')} AS timestamp, {cents('o_totalprice')} AS gas_used,
               o_orderstatus AS status FROM orders"""),
    "transactions": (["lines"], f"""
        SELECT {word('k * 1024 + n')} AS hash, n AS nonce, {word('k + 1000000')} AS block_hash, k AS block_number,
               n AS transaction_index, {addr('supp')} AS from_address, {addr('part')} AS to_address,
               cents * 1000000000 AS value, qty * 1000 + 21000 AS gas, n * 1000000000 AS gas_price, flag
        FROM lines"""),
    "logs": (["lines"], f"""
        SELECT n * 2 AS log_index, {word('k * 1024 + n')} AS transaction_hash, n AS transaction_index,
               {word('k + 1000000')} AS block_hash, k AS block_number,
               upper({addr('supp + 1000000')}) AS address,
               CASE WHEN flag = 'R' THEN '0x' ELSE {word('cents')} END AS data,
               CASE WHEN flag = 'R' THEN ['0x{TRANSFER_TOPIC[2:].upper()}', {word('supp')}, {word('part')}, {word('cents')}]
                    ELSE ['{TRANSFER_TOPIC}', {word('supp')}, {word('part')}] END AS topics
        FROM lines
        UNION ALL
        SELECT n * 2 + 1, {word('k * 1024 + n')}, n, {word('k + 1000000')}, k, upper({addr('supp + 1000000')}),
               CASE WHEN flag = 'R' THEN '0x' WHEN flag = 'N' THEN {word('cents')} || substr({word('cents')}, 3)
                    ELSE {word('cents')} END,
               CASE WHEN flag = 'R' THEN [] WHEN flag = 'N' THEN ['{TRANSFER_TOPIC}']
                    ELSE ['{OTHER_TOPIC}', {word('supp')}, {word('part')}] END
        FROM lines"""),
    "transfers": (["lines"], f"""
        SELECT {addr('supp + 1000000')} AS token_address, {addr('supp')} AS from_address, {addr('part')} AS to_address,
               cents AS value, {word('k * 1024 + n')} AS transaction_hash, n * 2 AS log_index, k AS block_number
        FROM lines"""),
    "calls": ([], f"""
        SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LINE_ORDER}) - 1 AS depth,
               count(*) OVER (PARTITION BY l_orderkey) AS calls, l_partkey AS part, l_suppkey AS supp,
               {cents('l_extendedprice')} AS cents, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag,
               l_linestatus AS linestatus FROM lineitem"""),
    "chain_traces": (["calls"], f"""
        SELECT k AS block_number, {word('k')} AS transaction_hash, CAST(0 AS BIGINT) AS transaction_index,
               {addr('supp')} AS from_address,
               CASE WHEN linestatus = 'F' THEN CASE WHEN flag <> 'R' THEN upper({addr('part + 3000000')}) END
                    ELSE {addr('part + 3000000')} END AS to_address,
               cents AS value,
               CASE WHEN linestatus = 'F' THEN '0x6060' ELSE '0xabcd' END AS input,
               CASE WHEN flag <> 'R' THEN CASE WHEN linestatus = 'F' THEN {_CODE} ELSE '0x' END END AS output,
               CASE WHEN linestatus = 'F' THEN 'create' ELSE 'call' END AS trace_type,
               CASE WHEN linestatus <> 'F' THEN 'call' END AS call_type,
               CAST(NULL AS VARCHAR) AS reward_type, qty * 100 AS gas, CASE WHEN flag <> 'R' THEN qty END AS gas_used,
               CAST(CASE WHEN depth + 1 < calls THEN 1 ELSE 0 END AS BIGINT) AS subtraces,
               CASE WHEN depth = 0 THEN '' ELSE repeat('0_', CAST(depth - 1 AS INTEGER)) || '0' END AS path,
               CASE WHEN flag = 'R' THEN 'Out of gas' END AS error, depth AS trace_index,
               CAST(1 - max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY depth) AS INTEGER) AS status
        FROM calls"""),
    "traces": (["chain_traces"], f"""
        SELECT *, trace_type || '_' || transaction_hash || '_' || path AS trace_id FROM chain_traces
        UNION ALL
        SELECT DISTINCT block_number, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
               {addr('block_number')}, CAST(5000000 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'reward',
               CAST(NULL AS VARCHAR), 'block', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), '',
               CAST(NULL AS VARCHAR), max(trace_index) OVER (PARTITION BY block_number) + 1, CAST(1 AS INTEGER),
               'reward_' || block_number || '_0' FROM chain_traces"""),
    "refs": (["edges"], """
        SELECT node, max(t) AS ref FROM (SELECT src AS node, t FROM edges UNION ALL SELECT dst, t FROM edges) GROUP BY node"""),
}


def with_views(names: list[str], sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        needs, _ = VIEWS[name]
        for need in needs:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return sql.strip()
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("RECURSIVE") else ""
    body = sql.strip()
    if recursive:
        body = body[len("RECURSIVE"):].strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    if body.startswith(","):
        return f"WITH {recursive}{ctes}\n{body}"
    return f"WITH {recursive}{ctes}\n{body}"
