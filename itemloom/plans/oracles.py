"""The queries of :mod:`itemloom.plans.queries` as SQL over the same tables."""

from __future__ import annotations

ORDERS = """
    SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority,
           c_mktsegment AS segment, o_totalprice AS totalprice, c_acctbal AS acctbal
    FROM orders JOIN customer ON o_custkey = c_custkey"""
EVENTS = "SELECT event_id AS id, event_type, value, CAST(user_id AS DOUBLE) AS user_id FROM events"
PART = """
    SELECT p_partkey AS id, p_brand AS brand, p_type AS type, p_size AS size,
           p_retailprice AS retailprice FROM part"""
DOCS = """
    SELECT doc_id AS id, lang, source, n_chars, quality, toxic
    FROM documents LEFT JOIN labels USING (doc_id)"""


def cells(wide: str, *columns: tuple[int, str, bool]) -> str:
    """Narrow rows of a wide query; each column is (field, name, numeric)."""
    parts = [
        f"SELECT CAST(id AS BIGINT) AS id, CAST({field} AS INTEGER) AS field, "
        f"CAST({name} AS VARCHAR) AS value_nominal, "
        f"{f'CAST({name} AS DOUBLE)' if numeric else 'CAST(NULL AS DOUBLE)'} AS value_numeric "
        f"FROM ({wide}) WHERE {name} IS NOT NULL"
        for field, name, numeric in columns
    ]
    return " UNION ALL ".join(parts)


ORDER_CELLS = cells(
    ORDERS, (1, "status", False), (2, "priority", False), (3, "segment", False), (4, "totalprice", True), (5, "acctbal", True)
)
EVENT_CELLS = cells(EVENTS, (1, "event_type", False), (2, "value", True), (3, "user_id", True))
PART_CELLS = cells(PART, (1, "brand", False), (2, "type", False), (3, "size", True), (4, "retailprice", True))
DOC_CELLS = cells(
    DOCS, (1, "lang", False), (2, "source", False), (3, "n_chars", True), (4, "quality", True), (5, "toxic", True)
)
ORDER_ITEMS = cells(ORDERS, (1, "status", False), (2, "priority", False), (3, "segment", False))


def frequencies(narrow: str) -> str:
    return (
        "SELECT field, value_nominal, value_numeric, count(*) AS frequency "
        f"FROM ({narrow}) GROUP BY ALL"
    )


def dictionary(narrow: str, start: int = 0) -> str:
    """Items of simple attributes whose id is the field's."""
    return (
        "SELECT field AS attribute, value_nominal AS value, count(*) AS frequency, "
        f"{start} + row_number() OVER (ORDER BY field, value_nominal) AS item "
        f"FROM ({narrow}) GROUP BY field, value_nominal"
    )


# Items of the orders dataset as sortable keys and texts.
ORDER_KEYS = f"""
    SELECT id, field AS attribute, field || ':' || value_nominal AS k,
           CASE field WHEN 1 THEN 'status' WHEN 2 THEN 'priority' ELSE 'segment' END
             || '(' || value_nominal || ')' AS t
    FROM ({ORDER_ITEMS})"""
AMOUNT_KEYS = f"""
    SELECT id, attribute, k, t FROM ({ORDER_KEYS})
    UNION ALL
    SELECT id, 4, '4:' || v, 'price(' || v || ')' FROM (SELECT id, CASE WHEN totalprice < 150000 THEN 'cheap'
        WHEN totalprice < 300000 THEN 'mid' ELSE 'dear' END AS v FROM ({ORDERS}))
    UNION ALL
    SELECT id, 5, '5:' || v, 'balance(' || v || ')' FROM (
        SELECT id, CASE WHEN acctbal < 0 THEN 'debt' ELSE 'credit' END AS v FROM ({ORDERS}))"""
BASKET_KEYS = """
    SELECT l_orderkey AS id, 1 AS attribute, '1:' || p_type AS k, 'type(' || p_type || ')' AS t
    FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL
    SELECT l_orderkey, 2, '2:' || p_brand, 'brand(' || p_brand || ')'
    FROM lineitem JOIN part ON l_partkey = p_partkey"""
DOC_LABEL_KEYS = """
    SELECT doc_id AS id, 2 AS attribute, '2:' || quality AS k, 'quality(' || quality || ')' AS t FROM labels
    JOIN documents USING (doc_id)
    UNION ALL
    SELECT doc_id, 3, '3:' || toxic, 'toxic(' || toxic || ')' FROM labels JOIN documents USING (doc_id)"""


def levels(keys: str, longest: int, where: str = "TRUE", support: float = 0.01) -> str:
    """Frequent itemsets by size as f1, f2, …; ``n`` counts the transactions."""
    parts = [
        f"it AS (SELECT DISTINCT id, attribute, k, t FROM ({keys}) WHERE {where})",
        "total AS (SELECT count(DISTINCT id) AS n FROM it)",
        f"""f1 AS (SELECT k AS k1, any_value(t) AS t1, any_value(attribute) AS a1, count(*) AS c FROM it
           GROUP BY k HAVING count(*) >= (SELECT ceil({support} * n) FROM total))""",
        "p AS (SELECT it.id, it.k, it.t, it.attribute AS a FROM it JOIN f1 ON it.k = f1.k1)",
    ]
    for size in range(2, longest + 1):
        sides = range(1, size + 1)
        columns = ", ".join(f"p{i}.k AS k{i}, any_value(p{i}.t) AS t{i}, any_value(p{i}.a) AS a{i}" for i in sides)
        joins = " ".join(f"JOIN p p{i} ON p{i}.id = p1.id AND p{i}.k > p{i - 1}.k" for i in sides[1:])
        groups = ", ".join(f"p{i}.k" for i in sides)
        parts.append(
            f"f{size} AS (SELECT {columns}, count(*) AS c FROM p p1 {joins} GROUP BY {groups} "
            f"HAVING count(*) >= (SELECT ceil({support} * n) FROM total))"
        )
    return "WITH RECURSIVE " + ", ".join(parts)


def rule_rows(longest: int, left: str = "TRUE", right: str = "TRUE", confidence: float = 0.3) -> str:
    """Rules of a least confidence from the levels; ``left``/``right`` are conditions on key ``{k}``."""
    selects = []
    for size in range(1, longest + 1):
        for y in range(1, size + 1):
            rest = [i for i in range(1, size + 1) if i != y]
            text = " || ' & ' || ".join(f"x.t{i}" for i in rest) if rest else "'*'"
            if rest:
                match = " AND ".join(f"l.k{j} = x.k{i}" for j, i in enumerate(rest, start=1))
                lefts, n_left = f"JOIN f{size - 1} l ON {match}", "l.c"
            else:
                lefts, n_left = "", "(SELECT n FROM total)"
            allowed = " AND ".join([f"({left.format(k=f'x.k{i}')})" for i in rest] + [f"({right.format(k=f'x.k{y}')})"])
            selects.append(
                f"SELECT {text} || ' → ' || x.t{y} AS text, {size} AS length, x.c AS n_both, "
                f"{n_left} AS n_left, r.c AS n_right, (SELECT n FROM total) AS n, "
                f"[{', '.join(f'x.k{i}' for i in rest)}] AS left_keys, x.k{y} AS right_key "
                f"FROM f{size} x JOIN f1 r ON r.k1 = x.k{y} {lefts} WHERE {allowed}"
            )
    return f"""rules AS (
        SELECT *, n_both / n AS support, n_both / n_left AS confidence,
               (n_both / n_left) / (n_right / n) AS lift
        FROM ({' UNION ALL '.join(selects)}) WHERE n_both / n_left >= {confidence})"""


SHOWN = (
    "text, CAST(length AS BIGINT) AS length, round(support, 6) AS support, "
    "round(confidence, 6) AS confidence, round(lift, 6) AS lift"
)
FOUR = "n_both AS a, n_left - n_both AS b, n_right - n_both AS c, n - n_left - n_right + n_both AS d"


def rules_sql(
    keys: str,
    longest: int = 3,
    columns: str = SHOWN,
    tail: str = "",
    where: str = "TRUE",
    left: str = "TRUE",
    right: str = "TRUE",
) -> str:
    return f"{levels(keys, longest, where)}, {rule_rows(longest, left, right)} SELECT {columns} FROM rules {tail}"


STATUS_RIGHT = "{k} LIKE '1:%'"
ORDERED = "ORDER BY confidence DESC, support DESC, length, left_keys, right_key"

#: Transactions as key lists, with their class label and weight, numbered.
CLASS_BASKETS = """
    b AS (SELECT row_number() OVER (ORDER BY keys, label) AS i, keys, label, w FROM (
        SELECT keys, label, count(*) AS w FROM (
            SELECT id, list(k ORDER BY k) AS keys, max(k) FILTER (attribute = 1) AS label FROM it GROUP BY id)
        GROUP BY keys, label))"""


def classifier(rules: str, limit: str = "") -> str:
    """The rules of table ``rules`` that database coverage selects, up to the least training error.

    Rules are walked by rank with the list of transactions that no selected rule has taken.
    """
    return f"""ranked AS (SELECT *, row_number() OVER ({ORDERED}) AS rank FROM {rules} {ORDERED} {limit}),
    hits AS (
        SELECT rank, list(i) AS covers, coalesce(list(i) FILTER (label = right_key), []) AS correct
        FROM ranked JOIN b ON list_has_all(keys, left_keys) GROUP BY rank),
    walk(rank, uncovered, taken) AS (
        SELECT CAST(0 AS BIGINT), (SELECT list(i) FROM b), CAST([] AS BIGINT[])
        UNION ALL
        SELECT r.rank, CASE WHEN list_has_any(uncovered, correct)
                 THEN list_filter(uncovered, lambda x: NOT list_contains(covers, x)) ELSE uncovered END,
               CASE WHEN list_has_any(uncovered, correct)
                 THEN list_filter(uncovered, lambda x: list_contains(covers, x)) ELSE [] END
        FROM walk JOIN (SELECT ranked.rank, coalesce(covers, []) AS covers, coalesce(correct, []) AS correct
                        FROM ranked LEFT JOIN hits USING (rank)) r ON r.rank = walk.rank + 1),
    chosen AS (SELECT * FROM walk WHERE len(taken) > 0),
    wrong AS (
        SELECT c.rank, coalesce(sum(w) FILTER (label <> right_key), 0) AS errors
        FROM (SELECT rank, unnest(taken) AS i FROM chosen) c JOIN b USING (i) JOIN ranked USING (rank) GROUP BY c.rank),
    open AS (
        SELECT rank, coalesce(sum(w), 0) - coalesce(max(w), 0) AS errors FROM (
            SELECT c.rank, label, sum(w) AS w FROM (SELECT rank, unnest(uncovered) AS i FROM chosen) c
            JOIN b USING (i) GROUP BY c.rank, label) GROUP BY rank),
    curve AS (
        SELECT rank, sum(wrong.errors) OVER (ORDER BY rank) + coalesce(open.errors, 0) AS errors
        FROM wrong LEFT JOIN open USING (rank)),
    last AS (SELECT rank FROM curve ORDER BY errors, rank LIMIT 1),
    kept AS (SELECT ranked.* FROM ranked JOIN chosen USING (rank) WHERE rank <= (SELECT rank FROM last))"""


CLASS_PRUNING = f"""{levels(ORDER_KEYS, 3)}, {rule_rows(3, right=STATUS_RIGHT)}, {CLASS_BASKETS},
    {classifier("rules", "LIMIT 100")} SELECT {SHOWN} FROM kept"""

AUTO_THRESHOLDS = f"""{levels(ORDER_KEYS, 3, support=0.001)}, {rule_rows(3, right=STATUS_RIGHT, confidence=0.1)},
    {CLASS_BASKETS},
    placed AS (SELECT *, row_number() OVER ({ORDERED}) AS place FROM rules),
    limits AS (SELECT DISTINCT support AS s, l FROM rules, (VALUES (1), (2), (3)) AS z(l)),
    grid AS (SELECT s, c, l FROM limits, (SELECT DISTINCT confidence AS c FROM rules)),
    member AS (SELECT s, c, l FROM grid JOIN placed p ON p.support >= s AND p.confidence >= c AND p.length <= l),
    matches AS (SELECT i, label, w, p.* FROM placed p JOIN b ON list_has_all(keys, left_keys)),
    first AS (
        SELECT s, l, i, any_value(label) AS label, any_value(w) AS w, min_by(right_key, place) AS right_key,
            min_by(confidence, place) AS confidence
        FROM limits JOIN matches m ON m.support >= s AND m.length <= l GROUP BY s, l, i),
    decided AS (
        SELECT s, c, l, sum(w) FILTER (label = right_key) AS good FROM grid JOIN first USING (s, l) WHERE confidence >= c GROUP BY s, c, l),
    undecided AS (
        SELECT s, c, l, max(w) AS good FROM (
            SELECT s, c, l, b.label, sum(b.w) AS w FROM grid CROSS JOIN b LEFT JOIN first f USING (s, l, i)
            WHERE f.confidence IS NULL OR f.confidence < c GROUP BY s, c, l, b.label) GROUP BY s, c, l),
    best AS (
        SELECT s, c, l FROM (SELECT s, c, l, count(*) AS n_rules FROM member GROUP BY s, c, l)
        LEFT JOIN decided USING (s, c, l) LEFT JOIN undecided USING (s, c, l)
        ORDER BY coalesce(decided.good, 0) + coalesce(undecided.good, 0) DESC, n_rules, c DESC, s DESC, l LIMIT 1),
    within AS (
        SELECT rules.* FROM rules, best WHERE support >= s AND confidence >= c AND length <= l),
    {classifier("within")}
    SELECT {SHOWN} FROM kept {ORDERED} LIMIT 100"""


def balanced_bins(values: str, target: str, bins: int | None) -> str:
    """Equal-frequency bins of (v, f) rows, or minimum-support bins if there is no number of bins.

    ``m`` lists the running counts, ``s`` the start positions with the number of values at the
    end.  Starts are found one by one; then each step of ``smoothing`` looks at one border,
    from the highest down, and passes repeat until one moves nothing.
    """
    if bins is None:
        end = "greatest(reached, starts[-1] + 1)"
        more = "TRUE"
        first = """SELECT CASE WHEN len(starts) > 1 AND total - m[starts[-1] + 1] < target
                   THEN starts[1:-2] ELSE starts END AS starts"""
        accept = "fuller - moved >= target"
    else:
        back = "CASE WHEN reached <= n AND m[reached] + m[reached + 1] >= 2 * goal THEN reached - 1 ELSE reached END"
        end = f"greatest(least({back}, n - {bins} + len(starts)), starts[-1] + 1)"
        more = f"len(starts) < {bins}"
        first = "SELECT starts"
        accept = """abs(target - fuller + moved) + abs(target - emptier - moved)
                  <= abs(target - fuller) + abs(target - emptier)"""
    return f"""
    WITH RECURSIVE src AS ({values}),
    arr AS (
        SELECT list(v ORDER BY v) AS vs, list_concat([0::BIGINT], list(upto ORDER BY v)) AS m, count(*) AS n,
               CAST(sum(f) AS BIGINT) AS total, CAST({target} AS BIGINT) AS target
        FROM (SELECT v, f, CAST(sum(f) OVER (ORDER BY v) AS BIGINT) AS upto FROM src)),
    st(starts, done) AS (
        SELECT [0::BIGINT], FALSE
        UNION ALL
        SELECT CASE WHEN e >= n THEN starts ELSE list_append(starts, e) END, e >= n FROM (
            SELECT starts, n, {end} AS e FROM (
                SELECT starts, n, m, goal, CASE WHEN goal > total THEN n + 1
                    ELSE len(list_filter(m, lambda x: x < goal)) END AS reached
                FROM (SELECT starts, n, m, total, m[starts[-1] + 1] + target AS goal FROM st, arr
                      WHERE NOT done AND {more})))),
    begun AS ({first} FROM (SELECT starts FROM st ORDER BY len(starts) DESC LIMIT 1), arr),
    smoothing(s, p, reach, kept, changed, done) AS (
        SELECT list_append(starts, n), len(starts) - 1, n - 1, FALSE, FALSE, len(starts) = 1 FROM begun, arr
        UNION ALL
        SELECT s2, CASE WHEN p > 1 THEN p - 1 ELSE len(s2) - 2 END, CASE WHEN p > 1 THEN reach2 ELSE n - 1 END,
               p > 1 AND kept2, p > 1 AND (changed OR s2 <> s), p = 1 AND NOT (changed OR s2 <> s)
        FROM (
            SELECT s, p, n, changed,
                CASE WHEN move <> 0 AND {accept} AND abs(fuller - emptier - 2 * moved) < fuller - emptier
                    THEN list_concat(s[1:p], [border + move], s[p + 2:]) ELSE s END AS s2,
                CASE WHEN move = 1 THEN border - 1 WHEN move = -1 THEN border - 3
                    WHEN high_mass = low_mass AND reach >= border THEN border - 1 ELSE low - 1 END AS reach2,
                move = -1 AND border - 2 <> low AS kept2
            FROM (
                SELECT *, greatest(low_mass, high_mass) AS fuller, least(low_mass, high_mass) AS emptier,
                    CASE move WHEN 1 THEN m[border + 2] - m[border + 1] ELSE m[border + 1] - m[border] END AS moved
                FROM (
                    SELECT *, CASE WHEN high_mass > low_mass AND (reach > border OR (reach = border AND kept)) THEN 1
                        WHEN high_mass < low_mass AND border - low >= 2 THEN -1 ELSE 0 END AS move
                    FROM (
                        SELECT *, m[border + 1] - m[low + 1] AS low_mass, m[high + 1] - m[border + 1] AS high_mass
                        FROM (SELECT *, s[p] AS low, s[p + 1] AS border, s[p + 2] AS high
                              FROM smoothing, arr WHERE NOT done)))))),
    closed AS (
        SELECT i - 1 AS bin, vs[s[i] + 1] AS lo, vs[s[i + 1]] AS hi, m[s[i + 1] + 1] - m[s[i] + 1] AS frequency
        FROM (SELECT s, vs, m, unnest(range(1, len(s))) AS i FROM smoothing, arr WHERE done))
    SELECT CAST(bin AS INTEGER) AS bin, coalesce((lag(hi) OVER (ORDER BY bin) + lo) / 2, lo) AS "from",
           coalesce((hi + lead(lo) OVER (ORDER BY bin)) / 2, hi) AS "to", TRUE AS from_inclusive,
           lead(lo) OVER (ORDER BY bin) IS NULL AS to_inclusive, CAST(frequency AS BIGINT) AS frequency
    FROM closed"""


TRIPLES = """
    SELECT 'urn:user:' || user_id AS subject, 'urn:event_type' AS predicate,
           CASE WHEN event_type = 'view' THEN 'urn:type:view' ELSE event_type END AS value_nominal,
           CAST(NULL AS DOUBLE) AS value_numeric, TRUE AS is_nominal FROM events
    UNION ALL
    SELECT 'urn:user:' || user_id, 'urn:value', CAST(value AS VARCHAR), value, FALSE FROM events
    UNION ALL
    SELECT 'urn:user:' || user_id, 'urn:props', props, NULL, TRUE FROM events"""


def label(lo: str, hi: str, lo_inclusive: str, hi_inclusive: str) -> str:
    def shown(x: str) -> str:
        return f"CAST(floor({x} * 1e6 + 0.5) / 1e6 AS VARCHAR)"

    return (
        f"CASE WHEN {lo_inclusive} THEN '[' ELSE '(' END || {shown(lo)} || ',' || {shown(hi)} || "
        f"CASE WHEN {hi_inclusive} THEN ']' ELSE ')' END"
    )


def equal_width(values: str, bins: int, low: str, high: str, low_in: bool, high_in: bool) -> str:
    """Histogram of (v, f) rows with equal-width bins, assigned by the borders that are shown."""
    inside = f"v {'>=' if low_in else '>'} lo AND v {'<=' if high_in else '<'} hi"
    return f"""
    WITH src AS ({values}), edge AS (SELECT {low} AS lo, {high} AS hi FROM src),
    e AS (SELECT lo, hi, (hi - lo) / {bins} AS w FROM edge),
    counted AS (SELECT b.bin AS bin, sum(f) AS f FROM src, e, range({bins}) AS b(bin)
                WHERE {inside} AND (b.bin = 0 OR v >= lo + b.bin * w)
                  AND (b.bin = {bins - 1} OR v < lo + (b.bin + 1) * w) GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * w AS "from",
           CASE WHEN b.bin = {bins - 1} THEN hi ELSE lo + (b.bin + 1) * w END AS "to",
           b.bin > 0 OR {str(low_in).upper()} AS from_inclusive,
           b.bin = {bins - 1} AND {str(high_in).upper()} AS to_inclusive,
           CAST(coalesce(f, 0) AS BIGINT) AS frequency
    FROM range({bins}) AS b(bin) CROSS JOIN e LEFT JOIN counted USING (bin)"""


def rounded_bins(sql: str) -> str:
    return f"""SELECT * REPLACE (round("from", 6) AS "from", round("to", 6) AS "to") FROM ({sql})"""


EVENT_VALUES = "SELECT value AS v, count(*) AS f FROM events GROUP BY value"
HISTOGRAM = equal_width(EVENT_VALUES, 10, "min(v)", "max(v)", True, True)
BOUNDED = equal_width(EVENT_VALUES, 8, "any_value(CAST(50 AS DOUBLE))", "any_value(CAST(300 AS DOUBLE))", False, True)

PROFILE = f"""
    WITH c AS ({DOC_CELLS}),
    f(field, name, type) AS (VALUES (1, 'lang', 'NOMINAL'), (2, 'source', 'NOMINAL'),
        (3, 'n_chars', 'NUMERIC'), (4, 'quality', 'NUMERIC'), (5, 'toxic', 'NUMERIC'))
    SELECT CAST(f.field AS INTEGER) AS field, name, type, count(value_nominal) AS support_nominal,
           count(value_numeric) AS support_numeric, count(DISTINCT value_nominal) AS distinct_nominal,
           count(DISTINCT value_numeric) AS distinct_numeric, min(value_numeric) AS "min",
           max(value_numeric) AS "max", round(avg(value_numeric), 6) AS "avg"
    FROM f LEFT JOIN c ON c.field = f.field GROUP BY f.field, name, type"""

#: Event values with a large part missing, so that smoothing has to move borders far.
SPARSE_VALUES = """SELECT CASE WHEN event_type <> 'view' THEN value END AS v, count(*) AS f FROM events
    WHERE event_type <> 'view' AND value IS NOT NULL GROUP BY 1"""
SIZE_CASE = "CASE WHEN size > 30 THEN 'large' WHEN size > 10 THEN 'mid' WHEN size >= 1 THEN 'small' ELSE CAST(size AS VARCHAR) END"
SIZE_BANDS = equal_width("SELECT CAST(p_size AS DOUBLE) AS v, count(*) AS f FROM part GROUP BY 1", 7, "min(v)", "max(v)", True, True)
SIDES = "(attribute = 2 OR (attribute = 3 AND value = 'BUILDING'))"


def labelled_bins(sql: str, attribute: int) -> str:
    text = label('"from"', '"to"', "from_inclusive", "to_inclusive")
    return f"SELECT CAST({attribute} AS INTEGER) AS attribute, {text} AS value, frequency, bin FROM ({sql})"


JOINED = "regexp_replace(text, '[ \\t]*(\\r\\n|\\r|\\n)[ \\t]*', ' ', 'g')"

ORACLES: dict[str, str] = {
    # scans, sources, sinks
    "csv_scan": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, trim({JOINED}) AS text FROM documents",
    "csv_select_fields": """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand,
        CAST(p_size AS VARCHAR) AS p_size FROM part""",
    "csv_null_tokens": "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM events",
    "cell_typing": f"""SELECT id, field, value_nominal, try_cast(value_nominal AS DOUBLE) AS value_numeric
        FROM ({ORDER_CELLS}) WHERE field IN (2, 4)""",
    "cell_typing_locale": "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders",
    "csv_compressed": """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, compression
        FROM part CROSS JOIN (VALUES ('gzip'), ('bzip2'), ('zip')) AS c(compression)""",
    "record_checks": """SELECT doc_id, 'cell too long' ||
            CASE WHEN strlen(concat_ws(',', doc_id, lang, source, text)) > 1000000
                 THEN ', record too long' ELSE '' END AS errors
        FROM documents WHERE length(text) > 255 OR length(source) > 255""",
    "csv_options": """SELECT CAST(event_id AS VARCHAR) AS event_id,
        CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM events""",
    "record_widths": """SELECT CAST(p_partkey AS VARCHAR) AS part, 'wrong number of values' AS errors FROM part
        WHERE p_partkey % 10 IN (3, 7)""",
    "text_preview": """SELECT concat_ws(';', event_id, event_type) AS line FROM events
        ORDER BY event_id LIMIT 20""",
    "rdf_scan": TRIPLES,
    "rdf_fields": f"""SELECT CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS field, name, type FROM (
        SELECT predicate AS name, CASE WHEN bool_or(is_nominal) THEN 'NOMINAL' ELSE 'NUMERIC' END AS type
        FROM ({TRIPLES}) GROUP BY predicate)""",
    "rdf_transactions": f"""
        WITH d AS (SELECT DISTINCT subject, predicate, value_nominal, value_numeric FROM ({TRIPLES}))
        SELECT dense_rank() OVER (ORDER BY subject) AS id,
               CAST(dense_rank() OVER (ORDER BY predicate) AS INTEGER) AS field,
               value_nominal, value_numeric FROM d""",
    "row_ids": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders",
    "narrow_instances": PART_CELLS,
    "streaming_support": f"""
        SELECT CAST(0 AS INTEGER) AS field, count(*) AS support_nominal, CAST(0 AS BIGINT) AS support_numeric FROM events
        UNION ALL
        SELECT field, count(*), count(value_numeric) FROM ({EVENT_CELLS}) GROUP BY field""",
    "rules_xml": f"""{levels(ORDER_KEYS, 3)}, {rule_rows(3)},
        sides AS (SELECT *, split_part(text, ' → ', 1) AS left_text, split_part(text, ' → ', 2) AS right_text FROM rules),
        none AS (SELECT NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, NULL::BIGINT AS d)
        SELECT 'rule' AS kind, text, left_text || ',' || right_text AS refs, {FOUR} FROM sides
        UNION ALL SELECT 'header', 'number-of-rules', '', count(*), NULL, NULL, NULL FROM rules
        UNION ALL SELECT DISTINCT 'DBA', left_text, replace(left_text, ' & ', ','), none.* FROM sides, none WHERE len(left_keys) = 2
        UNION ALL SELECT 'BBA', t1, replace(left(t1, -1), '(', '='), none.* FROM f1, none
            WHERE k1 IN (SELECT unnest(list_append(left_keys, right_key)) FROM rules)""",
    "json_values": f"""SELECT field, '{{"value":"' || value_nominal || '","frequency":' || count(*) || '}}' AS json
        FROM ({PART_CELLS}) GROUP BY field, value_nominal""",
    "json_instances": """SELECT p_partkey AS id, '{"id":' || p_partkey || ',"values":[{"field":1,"value":"' || p_brand
            || '"},{"field":2,"value":"' || p_type || '"}]}' AS json
        FROM part WHERE p_partkey > 20 AND p_partkey <= 70""",
    "json_intervals": f"""SELECT bin, '{{"from":' || "from" || ',"to":' || "to" || ',"fromInclusive":' || from_inclusive
            || ',"toInclusive":' || to_inclusive || ',"frequency":' || frequency || '}}' AS json FROM ({BOUNDED})""",
    # profile
    "value_frequencies": frequencies(PART_CELLS),
    "field_support": f"""SELECT field, count(*) AS support_nominal, count(value_numeric) AS support_numeric
        FROM ({DOC_CELLS}) GROUP BY field""",
    "field_cardinality": f"""SELECT field, count(DISTINCT value_nominal) AS distinct_nominal,
        count(DISTINCT value_numeric) AS distinct_numeric FROM ({ORDER_CELLS}) GROUP BY field""",
    "field_sketches": f"""SELECT field, count(DISTINCT value_nominal) AS distinct_nominal,
        count(DISTINCT value_numeric) AS distinct_numeric, TRUE AS near FROM ({ORDER_CELLS}) GROUP BY field""",
    "field_stats": f"""SELECT field, min(value_numeric) AS "min", max(value_numeric) AS "max",
        round(avg(value_numeric), 6) AS "avg" FROM ({ORDER_CELLS}) GROUP BY field
        HAVING min(value_numeric) IS NOT NULL""",
    "source_size": f"SELECT count(*) AS size FROM ({DOCS})",
    "source_profile": PROFILE,
    "field_detail": f"""SELECT field, name, type,
        CASE type WHEN 'NOMINAL' THEN distinct_nominal ELSE distinct_numeric END AS unique_values,
        CASE type WHEN 'NOMINAL' THEN support_nominal ELSE support_numeric END AS support FROM ({PROFILE})""",
    "numeric_stats": """SELECT CAST(2 AS INTEGER) AS field, min(value) AS "min", max(value) AS "max",
        round(avg(value), 6) AS "avg" FROM events""",
    "histogram": rounded_bins(HISTOGRAM),
    "histogram_bounded": rounded_bins(BOUNDED),
    "attribute_cardinality": f"""SELECT field AS attribute, count(DISTINCT value_nominal) AS unique_values
        FROM ({ORDER_ITEMS}) GROUP BY field""",
    # views and edits
    "instances_page": f"""SELECT id, field, value_nominal, value_numeric FROM ({PART_CELLS})
        WHERE field IN (1, 3) AND id > 20 AND id <= 70""",
    "aggregated_page": f"""
        WITH c AS (SELECT id, string_agg(field || '=' || value_nominal, ',' ORDER BY field) AS cells
                   FROM ({DOC_CELLS}) WHERE field IN (4, 5) GROUP BY id)
        SELECT r.id AS id, coalesce(cells, '') AS cells
        FROM range(21, (SELECT CAST(least(70, count(*)) AS BIGINT) + 1 FROM documents)) AS r(id)
        LEFT JOIN c ON c.id = r.id""",
    "typed_instances": f"""SELECT id, field, value_nominal, value_numeric FROM ({ORDER_CELLS})
        WHERE field IN (1, 4)""",
    "values_page": """SELECT CAST(4 AS INTEGER) AS field, CAST(p_retailprice AS VARCHAR) AS value_nominal,
            p_retailprice AS value_numeric, count(*) AS frequency
        FROM part GROUP BY p_retailprice ORDER BY p_retailprice LIMIT 50 OFFSET 20""",
    "items_page": f"""SELECT item, attribute, value, frequency FROM (
            {dictionary(cells(PART, (1, 'brand', False), (2, 'type', False)))})
        WHERE attribute = 1 ORDER BY item LIMIT 10 OFFSET 5""",
    "change_field_type": f"""
        WITH p AS (SELECT field, support_numeric, CASE field WHEN 5 THEN 'NOMINAL' ELSE type END AS type
                   FROM ({PROFILE})),
        c AS (SELECT CAST(x.flipped AS INTEGER) AS flipped, field, type,
              field = x.flipped AND (type = 'NUMERIC' OR support_numeric > 0) AS changed
              FROM p CROSS JOIN (VALUES (4), (1), (5)) AS x(flipped))
        SELECT flipped, field, changed, CASE WHEN NOT changed THEN type WHEN type = 'NUMERIC' THEN 'NOMINAL'
               ELSE 'NUMERIC' END AS type FROM c""",
    "drop_field": f"""SELECT field, CASE field WHEN 1 THEN 'brand' WHEN 2 THEN 'type' ELSE 'retailprice' END AS name,
            count(*) AS support_nominal, count(DISTINCT value_nominal) AS distinct_nominal
        FROM ({PART_CELLS}) WHERE field <> 3 GROUP BY field""",
    "drop_attribute": f"""SELECT field AS attribute, CASE field WHEN 1 THEN 'status' ELSE 'segment' END AS name,
            count(*) AS instances, count(DISTINCT value_nominal) AS unique_values
        FROM ({ORDER_ITEMS}) WHERE field <> 2 GROUP BY field""",
    "stored_source": f"""SELECT field, CASE field WHEN 1 THEN 'brand' WHEN 2 THEN 'type' ELSE 'retailprice' END AS name,
            count(*) AS support_nominal, count(DISTINCT value_nominal) AS distinct_nominal
        FROM ({PART_CELLS}) WHERE field <> 3 GROUP BY field""",
    "stored_dataset": f"""
        WITH c AS (SELECT field, value_nominal AS value, count(*) AS n FROM ({ORDER_ITEMS}) GROUP BY ALL),
        numbered AS (SELECT *, row_number() OVER (ORDER BY field, value) AS i, count(*) FILTER (field < 3) OVER () AS first_build,
            count(*) FILTER (field <> 2) OVER () AS others, count(*) OVER () AS everything, count(*) FILTER (field = 1) OVER () AS before FROM c)
        SELECT field AS attribute, CASE field WHEN 2 THEN everything + i - before ELSE i END AS item, value, n AS instances FROM numbered""",
    # attributes
    "simple_attribute": f"""SELECT item, CAST(attribute AS INTEGER) AS attribute, value, frequency
        FROM ({dictionary(cells(PART, (1, 'brand', False), (2, 'size', True)))})""",
    "nominal_enumeration": f"""SELECT row_number() OVER (ORDER BY value) AS item, CAST(1 AS INTEGER) AS attribute,
            value, frequency FROM (
        SELECT CASE WHEN priority = '5-LOW' THEN 'low' WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'high'
               ELSE priority END AS value, count(*) AS frequency FROM ({ORDERS}) GROUP BY 1)""",
    "numeric_intervals": f"SELECT id, CAST(1 AS INTEGER) AS attribute, {SIZE_CASE} AS value FROM ({PART})",
    "equidistant": f"""SELECT CAST(bin + 1 AS BIGINT) AS item, attribute, value, frequency FROM ({labelled_bins(
        equal_width(f"SELECT acctbal AS v, count(*) AS f FROM ({ORDERS}) GROUP BY 1", 5, "min(v)", "max(v)", True, True), 1)})""",
    "equifrequent": f"""SELECT CAST(bin + 1 AS BIGINT) AS item, attribute, value, frequency FROM ({labelled_bins(
        balanced_bins(f"SELECT totalprice AS v, count(*) AS f FROM ({ORDERS}) GROUP BY 1",
                      f"(SELECT ceil(count(*) / 10) FROM ({ORDERS}))", 10), 1)})""",
    "equisized": f"""SELECT CAST(bin + 1 AS BIGINT) AS item, attribute, value, frequency FROM ({labelled_bins(
        balanced_bins("SELECT value AS v, count(*) AS f FROM events WHERE value IS NOT NULL GROUP BY 1",
                      "(SELECT ceil(count(*) * CAST(0.1 AS DOUBLE)) FROM events)", None), 1)})""",
    "interval_smoothing": f"""SELECT CAST(1 AS INTEGER) AS attribute, *,
        round(frequency / (SELECT count(*) FROM lineitem), 6) AS share FROM ({balanced_bins(
        "SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS f FROM lineitem GROUP BY 1",
        "(SELECT ceil(count(*) / 7) FROM lineitem)", 7)})""",
    "equifrequent_sparse": f"""SELECT CAST(bin + 1 AS BIGINT) AS item, attribute, value, frequency FROM ({labelled_bins(
        balanced_bins(SPARSE_VALUES, "(SELECT ceil(count(*) / 20) FROM events)", 20), 1)})""",
    "cut_points": """
        WITH c AS (SELECT CAST(floor(value / 50) AS INTEGER) AS bin, min(value) AS lo, max(value) AS hi,
                   count(*) AS frequency FROM events GROUP BY 1),
        m AS (SELECT bin, frequency, lo, hi, lag(hi) OVER (ORDER BY bin) AS before,
              lead(lo) OVER (ORDER BY bin) AS after FROM c)
        SELECT CAST(1 AS INTEGER) AS attribute, bin, round(coalesce((before + lo) / 2, lo), 6) AS "from",
               round(coalesce((hi + after) / 2, hi), 6) AS "to", TRUE AS from_inclusive,
               after IS NULL AS to_inclusive, frequency FROM m""",
    "interval_labels": f"""SELECT p_partkey, {label('lo', '(lo + 7)', 'p_size > 10', 'p_size > 40')} AS label FROM (
        SELECT p_partkey, p_size, CAST(floor(p_retailprice / 7) AS DOUBLE) * 7.0::DOUBLE + p_size / 7.0::DOUBLE AS lo FROM part)""",
    "item_ids": f"""SELECT item, CAST(attribute AS INTEGER) AS attribute, value, frequency FROM (
        {dictionary(cells(PART, (1, 'brand', False), (2, 'type', False), (3, 'retailprice', True)), 100)})""",
    "item_instances": f"""
        WITH d AS ({dictionary(ORDER_ITEMS)})
        SELECT c.id AS id, c.field AS attribute, d.item AS item FROM ({ORDER_ITEMS}) c
        JOIN d ON d.attribute = c.field AND d.value = c.value_nominal""",
    "many_attributes": f"""
        WITH p AS ({PART}),
        recoded AS (
            SELECT 1 AS attribute, brand AS value FROM p UNION ALL
            SELECT 2, CASE WHEN type IN ('MEDIUM', 'PROMO') THEN 'fine' WHEN type = 'SMALL' THEN 'plain'
                   ELSE type END FROM p UNION ALL
            SELECT 3, {SIZE_CASE} FROM p)
        SELECT CAST(attribute AS INTEGER) AS attribute, value, count(*) AS frequency, count(*) AS rows
        FROM recoded GROUP BY attribute, value
        UNION ALL
        SELECT attribute, value, frequency, frequency FROM ({labelled_bins(SIZE_BANDS, 4)}) WHERE frequency > 0""",
    "lookup_items": f"""
        WITH d AS ({dictionary(ORDER_ITEMS)}),
        pairs AS (SELECT o_orderpriority AS value FROM orders UNION SELECT event_type FROM events)
        SELECT CAST(2 AS INTEGER) AS attribute, pairs.value AS value, item
        FROM pairs LEFT JOIN d ON d.attribute = 2 AND d.value = pairs.value""",
    "lookup_values": f"""
        WITH d AS ({dictionary(ORDER_ITEMS)})
        SELECT CAST(3 AS INTEGER) AS attribute, CAST(s.size AS BIGINT) AS item, value
        FROM (SELECT DISTINCT p_size AS size FROM part) s LEFT JOIN d ON d.attribute = 3 AND d.item = s.size""",
    # cedents
    "item_predicate": f"""SELECT attribute, value, attribute = 1 OR (attribute = 3 AND value = 'BUILDING') AS in_both,
            NOT (attribute = 1 OR (attribute = 3 AND value = 'BUILDING')) AS in_neither
        FROM ({dictionary(ORDER_ITEMS)})""",
    "select_items": f"SELECT attribute, value FROM ({dictionary(ORDER_ITEMS)}) WHERE {SIDES}",
    "intersect_items": f"""SELECT attribute, value FROM ({dictionary(ORDER_ITEMS)}) WHERE {SIDES}
        INTERSECT SELECT attribute, value FROM ({dictionary(ORDER_ITEMS)}) WHERE attribute = 3""",
    "subtract_items": f"""SELECT attribute, value FROM ({dictionary(ORDER_ITEMS)}) WHERE attribute = 3
        EXCEPT SELECT attribute, value FROM ({dictionary(ORDER_ITEMS)}) WHERE {SIDES}""",
    "appearance": f"""SELECT attribute, value, {SIDES} AS can_lhs, attribute IN (1, 3) AS can_rhs
        FROM ({dictionary(ORDER_ITEMS)}) WHERE {SIDES} OR attribute IN (1, 3)""",
    "filter_item_instances": f"""
        WITH d AS ({dictionary(ORDER_ITEMS)})
        SELECT c.id AS id, c.field AS attribute, d.item AS item FROM ({ORDER_ITEMS}) c
        JOIN d ON d.attribute = c.field AND d.value = c.value_nominal
        WHERE d.attribute IN (1, 2) OR d.value = 'BUILDING'""",
    # mining
    "basket_transactions": f"""SELECT id, string_agg(substr(k, 3), ',' ORDER BY k) AS texts
        FROM (SELECT DISTINCT id, k FROM ({BASKET_KEYS})) GROUP BY id""",
    "longest_transaction": f"""SELECT CAST(max(size) AS INTEGER) AS max_length FROM (
        SELECT count(DISTINCT k) AS size FROM ({BASKET_KEYS}) GROUP BY id)""",
    "frequent_itemsets": f"""{levels(BASKET_KEYS, 3)}
        SELECT CAST(size AS BIGINT) AS size, c AS count, round(c / (SELECT n FROM total), 6) AS support, texts FROM (
            SELECT 1 AS size, c, substr(k1, 3) AS texts FROM f1 UNION ALL
            SELECT 2, c, substr(k1, 3) || ',' || substr(k2, 3) FROM f2 UNION ALL
            SELECT 3, c, substr(k1, 3) || ',' || substr(k2, 3) || ',' || substr(k3, 3) FROM f3)""",
    "association_rules": rules_sql(ORDER_KEYS),
    "flagship": rules_sql(ORDER_KEYS, 2),
    "basket_rules": rules_sql(BASKET_KEYS),
    "basket_task": rules_sql(BASKET_KEYS),
    "pattern_rules": rules_sql(
        ORDER_KEYS,
        where="attribute IN (1, 2) OR k = '3:BUILDING'",
        left="{k} NOT LIKE '1:%'",
        right=STATUS_RIGHT,
    ),
    "negated_pattern_rules": rules_sql(ORDER_KEYS, right="{k} <> '1:O'"),
    "lift_filter": rules_sql(ORDER_KEYS, tail="WHERE lift >= 1.0"),
    "four_fold": rules_sql(ORDER_KEYS, columns=f"text, {FOUR}"),
    "rule_measures": rules_sql(ORDER_KEYS),
    "four_fold_from_measures": f"""SELECT text, a, b, c, (SELECT count(*) FROM documents) - a - b - c AS d FROM (
        SELECT text, a, CAST(round_even(a / confidence - a, 0) AS BIGINT) AS b,
               CAST(round_even(confidence * size / lift - a, 0) AS BIGINT) AS c FROM (
            SELECT *, CAST(round_even(support * size, 0) AS BIGINT) AS a FROM (
                SELECT *, (SELECT count(*) FROM documents) AS size FROM ({rules_sql(
                    DOC_LABEL_KEYS, 3, "*", left="{k} LIKE '2:%'", right="{k} LIKE '3:%'")}))))""",
    "staged_mining": rules_sql(
        AMOUNT_KEYS, 4, f"{SHOWN}, CAST(CASE WHEN length <= 3 THEN 1 ELSE 2 END AS INTEGER) AS stage"
    ),
    "class_pruning": CLASS_PRUNING,
    "auto_thresholds": AUTO_THRESHOLDS,
    "rule_limit": rules_sql(ORDER_KEYS, tail=f"{ORDERED} LIMIT 100"),
    "mining_task": rules_sql(
        ORDER_KEYS,
        columns=f"{SHOWN}, (SELECT count(*) >= 50 FROM rules WHERE lift >= 1.0) AS limited",
        tail=f"WHERE lift >= 1.0 {ORDERED} LIMIT 50",
    ),
    "merged_results": rules_sql(
        ORDER_KEYS, tail="WHERE right_key LIKE '1:%' OR (right_key LIKE '2:%' AND length <= 2)"
    ),
    "rule_coverage": rules_sql(
        ORDER_KEYS, columns="text, n_left AS covered, n_both AS correct", right=STATUS_RIGHT
    ),
    "rule_text": rules_sql(ORDER_KEYS, columns="text, n_both"),
    "rule_items": f"""{levels(ORDER_KEYS, 3)}, {rule_rows(3)},
        used AS (SELECT DISTINCT unnest(list_append(left_keys, right_key)) AS k FROM rules)
        SELECT t1 AS text, CASE a1 WHEN 1 THEN 'status' WHEN 2 THEN 'priority' ELSE 'segment' END AS name,
               substr(k1, 3) AS value FROM f1 JOIN used ON used.k = f1.k1""",
    "rule_cedents": f"""{levels(BASKET_KEYS, 3)}, {rule_rows(3)}
        SELECT DISTINCT array_to_string([substr(x, 3) FOR x IN left_keys], ',') AS texts
        FROM rules WHERE len(left_keys) >= 2""",
}
