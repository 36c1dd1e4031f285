"""SQL that states the results of the conversation queries."""

#: The bits of CRC-32, one byte after the other: 4294967295 and 3988292384 are its fixed start and polynomial.
CRC32 = """xor(4294967295, list_reduce([ascii(x)::BIGINT FOR x IN string_split({text}, '')], lambda state, byte:
    list_reduce(range(8), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(state, byte)), 4294967295::BIGINT))"""

TRIE = f"""
    WITH o AS (
        SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
               {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn,
               len([w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> '']) AS words
        FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (
        SELECT c, count(*) AS n FROM o GROUP BY c
    ), ids AS (
        SELECT own.c, {CRC32.format(text="own.c::VARCHAR")} % 4 AS h, own.c - own.c % 20 AS base, coalesce(b.n, 0) AS n FROM own LEFT JOIN own AS b ON b.c = own.c - own.c % 20
    ), r AS (
        SELECT i.c, o.k AS d, o.turn, o.words FROM ids AS i JOIN o ON o.c = i.base WHERE o.k <= i.h
        UNION ALL SELECT i.c, o.k - i.h + least(i.h, i.n), o.turn, o.words FROM ids AS i JOIN o ON o.c = i.c WHERE o.k > i.h
    ), seq AS (
        SELECT c, coalesce(list(turn ORDER BY d) FILTER (d IS NOT NULL), []) AS s, coalesce(list(words ORDER BY d) FILTER (d IS NOT NULL), []) AS w FROM ids LEFT JOIN r USING (c) GROUP BY c
    ), prefix AS (
        SELECT c, d, len(s) = d AS ends, s[1:d] AS key, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS words FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seq)
    ), node AS (
        SELECT d, key, min(c) AS conv_id, count(*) AS n, any_value(words) AS words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ids
        FROM prefix GROUP BY d, key
    ), child AS (
        SELECT d - 1 AS d, key[1:d - 1] AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
    ), below AS (
        SELECT a.d, a.key, sum((b.n - 1) * b.words) AS saved, count(*) FILTER (child.n IS NULL) AS leaves
        FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM node) AS b JOIN node AS a ON a.d = b.up AND a.key = b.key[1:b.up] LEFT JOIN child ON child.d = b.d AND child.key = b.key
        GROUP BY ALL
    )
    SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children, below.leaves AS n_leaves,
           below.saved::BIGINT AS saved_tokens, sha256(node.ids) AS ends_sha256
    FROM node JOIN below USING (d, key) LEFT JOIN child USING (d, key) LEFT JOIN node AS up ON up.d = node.d - 1 AND up.key = node.key[1:node.d - 1]
"""


def _repair_step() -> str:
    """The best (cost, edits, text) at each place of the pattern after one more row; at most one row is worth inserting before it."""
    fill, keep = (2, 2, 3, 2), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {2: "user", 3: "assistant"}
    options: dict[int, list[str]] = {x: [] for x in range(4)}
    for start in range(4):
        for inserted in (False, True):
            place = fill[start] if inserted else start
            cost, edits, text = (2, "I", f" || chr(10) || '{name[place]}:'") if inserted else (0, "", "")
            a = f"dp.a[{start + 1}]"

            def option(to, letter, more, line, allowed, a=a, cost=cost, edits=edits, text=text):
                options[to].append(f"{{'c': CASE WHEN {allowed} THEN {a}.c + {cost} + {more} ELSE 1000000 END, 's': {a}.s || '{edits}{letter}', 'o': {a}.o{text}{line}}}")

            option(place, "D", "3", "", "true")
            for (at, initial), to in keep.items():
                if at == place:
                    option(to, "K", "cut", " || chr(10) || role || ':' || text", f"NOT gone AND role[1] = '{initial}'")
            option(fill[place], "R", "2 + cut", f" || chr(10) || '{name[fill[place]]}:' || text", "NOT gone")
    return ", ".join(f"list_min([{', '.join(options[x])}])" for x in range(4))


REPAIR = f"""
    WITH RECURSIVE filled AS (
        SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {CRC32.format(text="(conv_id::VARCHAR || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
        FROM conversations WHERE conv_id IS NOT NULL
    ), hurt AS (
        SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM filled
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS k FROM hurt
    ), signed AS (
        SELECT *, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS sign, row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 AS again FROM placed
    ), row AS (
        SELECT c, k, turn, role, text, sign = '' AS blank, sign <> '' AND again AS twice, (sign <> '' AND NOT again AND sign NOT IN ('.', '!', '?'))::INTEGER AS cut, sign = '' OR again AS gone,
               lag(role[1]) OVER (PARTITION BY c ORDER BY k) || role[1] AS pair
        FROM signed
    ), counts AS (
        SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate, sum(cut) AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
        FROM row GROUP BY c
    ), dp AS (
        SELECT c, 0 AS i, [{{'c': 0, 's': '', 'o': ''}}, {{'c': 1000000, 's': '', 'o': ''}}, {{'c': 1000000, 's': '', 'o': ''}}, {{'c': 1000000, 's': '', 'o': ''}}] AS a FROM counts
        UNION ALL SELECT dp.c, i + 1, [{_repair_step()}] FROM dp JOIN row ON row.c = dp.c AND row.k = i + 1
    ), done AS (
        SELECT dp.c, list_min([a[1], a[4], {{'c': a[2].c + 4, 's': a[2].s || 'II', 'o': a[2].o || chr(10) || 'user:' || chr(10) || 'assistant:'}},
                               {{'c': a[3].c + 2, 's': a[3].s || 'I', 'o': a[3].o || chr(10) || 'assistant:'}}]) AS best
        FROM dp JOIN counts ON counts.c = dp.c AND counts.n = i
    )
    SELECT ids.c AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.s, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT c FROM filled) AS ids LEFT JOIN counts ON counts.c = ids.c LEFT JOIN done ON done.c = ids.c
"""
