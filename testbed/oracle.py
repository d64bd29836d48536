"""DuckDB relations that state the expected result of every operator.

Written from the definitions, in long form, with none of the library's code:
joins and plain grouping where the library folds arrays, recursion where it
groups packages, self-joins where it sends values to neighbours.
"""

from __future__ import annotations

from testbed.chain_view import with_clause

SENS = (("30", "0.3"), ("50", "0.5"), ("70", "0.7"))
REASONS = ("nonstandard_script", "bare_multisig", "op_return", "multi_op_return", "dust",
           "version", "truc", "oversized", "undersized", "scriptsig_size",
           "scriptsig_nonpush", "sub_minrelay")
OFFSETS = "(VALUES (-3), (-2), (-1), (1), (2), (3)) AS off(o)"
HEX = "'0123456789abcdef'"


def _byte(column: str, position: str) -> str:
    high, low = (f"instr({HEX}, substr({column}, {position} + {i}, 1)) - 1" for i in (0, 1))
    return f"CASE WHEN length({column}) >= {position} + 1 THEN ({high}) * 16 + {low} END"


KEY = "(21(02|03)[0-9a-f]{64}|41(04|06|07)[0-9a-f]{128})"

RELATIONS: dict[str, str] = {
    "out_facts": f"""
      SELECT *, coalesce(length(script), 0) // 2 AS nbytes,
        coalesce(starts_with(script, '6a'), FALSE) AS op_ret,
        regexp_full_match(script, '76a914[0-9a-f]{{40}}88ac') AS p2pkh,
        regexp_full_match(script, 'a914[0-9a-f]{{40}}87') AS p2sh,
        regexp_full_match(script, '{KEY}ac') AS p2pk,
        regexp_full_match(script, '(5[1-9a-f]|60){KEY}+(5[1-9a-f]|60)ae') AS multi,
        {_byte('script', '1')} AS b0, {_byte('script', '3')} AS b1,
        {_byte('script', '(length(script) - 3)')} AS bn
      FROM outs""",
    "out_kinds": """
      SELECT *, coalesce(b0 - 80, 0) AS m, coalesce(bn - 80, 0) AS n,
        coalesce(nbytes BETWEEN 4 AND 42 AND (b0 = 0 OR b0 BETWEEN 81 AND 96)
          AND b1 + 2 = nbytes, FALSE) AS witness,
        CASE WHEN b0 > 80 THEN b0 - 80 ELSE 0 END AS wver, coalesce(b1, 0) AS wbytes
      FROM out_facts""",
    "out_class": """
      SELECT *, (p2pkh OR p2sh OR p2pk OR op_ret OR (multi AND m <= n)
          OR (witness AND (wver > 0 OR wbytes IN (20, 32)))) AS standard,
        CASE WHEN op_ret OR nbytes > 10000 THEN 0 ELSE (3000 * (8
          + CASE WHEN nbytes < 253 THEN 1 WHEN nbytes < 65536 THEN 3 ELSE 5 END + nbytes
          + CASE WHEN witness THEN 67 ELSE 148 END)) // 1000 END AS threshold
      FROM out_kinds""",
    "out_stats": """
      SELECT k, max(CASE WHEN multi THEN n ELSE 0 END) AS bare_multisig_max_n,
        count(*) FILTER (WHERE op_ret) AS op_return_count,
        max(CASE WHEN op_ret THEN nbytes ELSE 0 END) AS op_return_max_bytes,
        CAST(sum(CASE WHEN op_ret THEN nbytes ELSE 0 END) AS BIGINT) AS op_return_total_bytes,
        count(*) FILTER (WHERE NOT standard) AS nonstandard_outputs,
        count(*) FILTER (WHERE value < threshold) AS dust_outputs,
        count(*) FILTER (WHERE value < threshold AND NOT multi) AS dust_outputs_excl_multisig
      FROM out_class GROUP BY k""",
    "in_stats": f"""
      SELECT k, max(coalesce(length(script), 0) // 2) AS max_scriptsig_bytes,
        bool_or(coalesce({_byte('script', '1')} > 96, FALSE)) AS opens_with_nonpush_opcode
      FROM ins GROUP BY k""",
    "base": """
      SELECT t.k, t.tx_hash, t.block_number, t.block_timestamp,
        CAST(date_trunc('month', t.block_timestamp) AS DATE) AS block_month, t.is_coinbase,
        t.fee, t.virtual_size, t.serialized_size, coalesce(t.version, 1) AS version,
        coalesce(o.bare_multisig_max_n, 0) AS bare_multisig_max_n,
        coalesce(o.op_return_count, 0) AS op_return_count,
        coalesce(o.op_return_max_bytes, 0) AS op_return_max_bytes,
        coalesce(o.op_return_total_bytes, 0) AS op_return_total_bytes,
        coalesce(o.nonstandard_outputs, 0) AS nonstandard_outputs,
        coalesce(o.dust_outputs, 0) AS dust_outputs,
        coalesce(o.dust_outputs_excl_multisig, 0) AS dust_outputs_excl_multisig,
        coalesce(i.max_scriptsig_bytes, 0) AS max_scriptsig_bytes,
        coalesce(i.opens_with_nonpush_opcode, FALSE) AS opens_with_nonpush_opcode
      FROM tx t LEFT JOIN out_stats o USING (k) LEFT JOIN in_stats i USING (k)""",
    "rated": """
      SELECT *, CAST(fee AS DOUBLE) / NULLIF(virtual_size, 0) AS raw_fee_rate,
        CASE WHEN block_timestamp < TIMESTAMP '2025-09-04' THEN CAST(1 AS DOUBLE)
          ELSE CAST(0.1 AS DOUBLE) END AS min_relay_rate,
        CASE WHEN block_timestamp < TIMESTAMP '2025-10-08' THEN op_return_max_bytes
          ELSE op_return_total_bytes END AS datacarrier_bytes,
        CASE WHEN block_timestamp < TIMESTAMP '2025-10-08' THEN 83 ELSE 100000 END
          AS datacarrier_limit,
        CASE WHEN block_timestamp < TIMESTAMP '2024-10-04' THEN 2 ELSE 3 END
          AS max_standard_version,
        CASE WHEN block_timestamp < TIMESTAMP '2025-04-15' THEN 0 ELSE 1 END
          AS max_dust_outputs,
        coalesce((4 * virtual_size - serialized_size) // 3, 65) AS max_nonwitness_size
      FROM base""",
    "edges": """
      SELECT c.block_number, c.tx_hash AS child_hash, p.tx_hash AS parent_hash,
        c.raw_fee_rate AS child_rate, c.min_relay_rate AS child_min_relay,
        (c.version = 3) <> (p.version = 3) AS truc_version_clash
      FROM rated c JOIN (SELECT DISTINCT k, spent FROM ins) i ON i.k = c.k
      JOIN rated p ON p.tx_hash = i.spent AND p.block_number = c.block_number
      WHERE NOT c.is_coinbase""",
    "by_child": """
      SELECT child_hash AS tx_hash, string_agg(DISTINCT parent_hash, ',' ORDER BY parent_hash)
        AS parents, bool_or(truc_version_clash) AS has_truc_version_clash
      FROM edges GROUP BY child_hash""",
    "by_parent": """
      SELECT parent_hash AS tx_hash, count(*) AS child_count,
        bool_or(child_rate >= child_min_relay) AS has_paying_child
      FROM edges GROUP BY parent_hash""",
    "linked": """
      SELECT r.*, p.parents, coalesce(p.has_truc_version_clash, FALSE) AS clash,
        p.tx_hash IS NOT NULL AS has_in_block_parent,
        coalesce(c.child_count, 0) AS child_count,
        coalesce(c.has_paying_child, FALSE) AS has_paying_child,
        p.tx_hash IS NOT NULL OR c.tx_hash IS NOT NULL AS in_package
      FROM rated r LEFT JOIN by_child p USING (tx_hash) LEFT JOIN by_parent c USING (tx_hash)""",
    "judged": """
      SELECT *,
        nonstandard_outputs > 0 AND NOT is_coinbase AS nonrelay_nonstandard_script,
        bare_multisig_max_n > 3 AND NOT is_coinbase AS nonrelay_bare_multisig,
        datacarrier_bytes > datacarrier_limit AND NOT is_coinbase AS nonrelay_op_return,
        block_timestamp < TIMESTAMP '2025-10-08' AND op_return_count > 1 AND NOT is_coinbase
          AS nonrelay_multi_op_return,
        NOT is_coinbase AND CASE WHEN block_timestamp < TIMESTAMP '2025-04-15'
          THEN dust_outputs_excl_multisig > 0
          ELSE dust_outputs > 1 OR (dust_outputs = 1
            AND (coalesce(fee, 0) <> 0 OR child_count = 0)) END AS nonrelay_dust,
        NOT is_coinbase AND NOT version BETWEEN 1 AND max_standard_version
          AS nonrelay_version,
        NOT is_coinbase AND block_timestamp >= TIMESTAMP '2024-10-04'
          AND (clash OR (version = 3 AND virtual_size
            > CASE WHEN has_in_block_parent THEN 1000 ELSE 10000 END)) AS nonrelay_truc,
        NOT is_coinbase AND virtual_size > 100000 AS nonrelay_oversized,
        NOT is_coinbase AND max_nonwitness_size < 65 AS nonrelay_undersized,
        NOT is_coinbase AND max_scriptsig_bytes > 1650 AS nonrelay_scriptsig_size,
        NOT is_coinbase AND opens_with_nonpush_opcode AS nonrelay_scriptsig_nonpush,
        coalesce(NOT is_coinbase AND raw_fee_rate < min_relay_rate AND NOT has_paying_child,
          FALSE) AS nonrelay_sub_minrelay
      FROM linked""",
    "members": """
      SELECT block_number, tx_hash, coalesce(fee, 0) AS fee, virtual_size, block_month, parents
      FROM judged WHERE in_package AND NOT is_coinbase""",
    "links": """
      SELECT e.block_number, e.child_hash, e.parent_hash FROM edges e
      SEMI JOIN members p ON p.tx_hash = e.parent_hash""",
    "both_ways": """
      SELECT child_hash AS x, parent_hash AS y FROM links
      UNION SELECT parent_hash, child_hash FROM links""",
    "reach": """
      SELECT tx_hash AS a, tx_hash AS b FROM members
      UNION SELECT r.a, w.y FROM reach r JOIN both_ways w ON w.x = r.b""",
    "forebears": """
      SELECT tx_hash AS a, tx_hash AS b FROM members
      UNION SELECT f.a, l.parent_hash FROM forebears f JOIN links l ON l.child_hash = f.b""",
    "package_of": "SELECT a AS tx_hash, min(b) AS package_id FROM reach GROUP BY a",
    "package_sums": """
      SELECT p.package_id, count(*) AS package_tx_count, CAST(sum(m.fee) AS BIGINT)
        AS package_fee, CAST(sum(m.virtual_size) AS BIGINT) AS package_vsize
      FROM package_of p JOIN members m USING (tx_hash) GROUP BY p.package_id""",
    "forebear_sums": """
      SELECT f.a AS tx_hash, count(*) AS ancestor_count,
        CAST(sum(m.virtual_size) AS BIGINT) AS ancestor_vsize
      FROM forebears f JOIN members m ON m.tx_hash = f.b GROUP BY f.a""",
    "packed": """
      SELECT m.tx_hash, m.block_number, p.package_id, s.package_tx_count, s.package_fee,
        s.package_vsize, CAST(s.package_fee AS DOUBLE) / NULLIF(s.package_vsize, 0)
          AS effective_fee_rate, f.ancestor_count, f.ancestor_vsize
      FROM members m JOIN package_of p USING (tx_hash) JOIN package_sums s USING (package_id)
      JOIN forebear_sums f USING (tx_hash)""",
    "priced": f"""
      SELECT j.* , coalesce(NOT is_coinbase AND (
          (block_timestamp < TIMESTAMP '2026-04-20'
            AND (k2.ancestor_count > 25 OR k2.ancestor_vsize > 101000))
          OR (block_timestamp >= TIMESTAMP '2024-10-04' AND version = 3
            AND k2.ancestor_count > 2)), FALSE) AS nonrelay_ancestor_limit,
        ({' OR '.join('nonrelay_' + r for r in REASONS)}) AS direct_verdict,
        CASE WHEN k2.tx_hash IS NOT NULL THEN k2.effective_fee_rate
          WHEN NOT in_package AND NOT is_coinbase THEN raw_fee_rate END AS effective_fee_rate,
        CASE WHEN k2.tx_hash IS NOT NULL THEN k2.package_id
          WHEN NOT in_package AND NOT is_coinbase THEN j.tx_hash END AS package_id,
        CASE WHEN k2.tx_hash IS NOT NULL THEN k2.package_tx_count
          WHEN NOT in_package AND NOT is_coinbase THEN 1 END AS package_tx_count
      FROM judged j LEFT JOIN packed k2 ON k2.tx_hash = j.tx_hash""",
    "verdicts": """
      SELECT *, direct_verdict OR nonrelay_ancestor_limit AS is_nonrelayable FROM priced""",
    "percentiles": """
      SELECT block_number,
        quantile_cont(CASE WHEN NOT is_nonrelayable THEN effective_fee_rate END, 0.05)
          AS p05_fee_rate,
        quantile_cont(effective_fee_rate, 0.05) AS p05_all,
        quantile_cont(CASE WHEN NOT is_nonrelayable THEN effective_fee_rate END, 0.5)
          AS median_fee_rate,
        count(*) AS priced_tx_count
      FROM verdicts WHERE NOT is_coinbase AND effective_fee_rate IS NOT NULL
      GROUP BY block_number""",
    "floors": f"""
      SELECT c.block_number, CASE WHEN count(n.p05_fee_rate) = 6 THEN median(n.p05_fee_rate) END
        AS floor_fee_rate
      FROM percentiles c CROSS JOIN {OFFSETS}
      LEFT JOIN percentiles n ON n.block_number = c.block_number + o
      GROUP BY c.block_number""",
    "texts": """
      SELECT *, coalesce(decode(unhex(coinbase_param)), '') AS coinbase_text FROM heads""",
    "tag_of": """
      SELECT lower(tag) AS tag, min(pool_name) AS pool_name FROM pool_tags GROUP BY lower(tag)""",
    "address_of": """
      SELECT address, min(pool_name) AS pool_name FROM pool_addresses
      WHERE address <> '' AND NOT contains(address, ' ')
      GROUP BY address HAVING count(DISTINCT pool_name) = 1""",
    "by_tag": """
      SELECT number, pool_name FROM (
        SELECT t.number, g.pool_name, row_number() OVER (PARTITION BY t.number
          ORDER BY length(g.tag) DESC, g.pool_name) AS place
        FROM texts t JOIN tag_of g ON contains(lower(t.coinbase_text), g.tag)) WHERE place = 1""",
    "by_address": """
      SELECT t.block_number AS number, min(a.pool_name) AS pool_name
      FROM tx t JOIN outs o USING (k) JOIN address_of a USING (address)
      WHERE t.is_coinbase GROUP BY t.block_number""",
    "attributed": """
      SELECT h.number AS block_number, h.hash AS block_hash, h.ts AS block_timestamp,
        CAST(h.ts AS DATE) AS block_date,
        CAST(date_trunc('month', h.ts) AS DATE) AS block_month, h.weight,
        h.size AS block_size, h.transaction_count,
        coalesce(t.pool_name, a.pool_name, 'Unknown') AS pool_name,
        CASE WHEN t.pool_name IS NOT NULL THEN 'coinbase_tag'
          WHEN a.pool_name IS NOT NULL THEN 'payout_address' ELSE 'unattributed' END
          AS pool_source
      FROM heads h LEFT JOIN by_tag t USING (number) LEFT JOIN by_address a USING (number)""",
    "fullness": f"""
      SELECT c.block_number, c.weight >= 3900000 AS weight_full,
        count(*) FILTER (WHERE n.weight >= 3900000) AS full_neighbours
      FROM attributed c CROSS JOIN {OFFSETS}
      LEFT JOIN attributed n ON n.block_number = c.block_number + o
      GROUP BY c.block_number, c.weight""",
    "blocks": """
      SELECT a.*, f.floor_fee_rate, p.p05_fee_rate, p.median_fee_rate, u.weight_full,
        u.full_neighbours, u.weight_full AND u.full_neighbours >= 4 AS is_full
      FROM attributed a LEFT JOIN floors f USING (block_number)
      LEFT JOIN percentiles p USING (block_number) LEFT JOIN fullness u USING (block_number)""",
    "flagged": "SELECT v.*, b.pool_name, b.pool_source, b.floor_fee_rate, b.median_fee_rate, "
               "b.weight AS block_weight, b.is_full, b.block_hash, " + ", ".join(
                   "coalesce(b.is_full AND NOT v.is_nonrelayable AND NOT v.is_coinbase AND "
                   f"v.effective_fee_rate < CAST({s} AS DOUBLE) * b.floor_fee_rate, FALSE) "
                   f"AS low_fee_{label}" for label, s in SENS) + ", "
               "CASE WHEN b.floor_fee_rate > v.effective_fee_rate THEN (b.floor_fee_rate "
               "- v.effective_fee_rate) * v.virtual_size "
               "WHEN b.floor_fee_rate IS NOT NULL AND v.effective_fee_rate IS NOT NULL THEN 0 "
               "END AS lower_band_sats, b.median_fee_rate * v.virtual_size AS upper_band_sats "
               "FROM verdicts v JOIN blocks b USING (block_number)",
    "low": "SELECT * FROM flagged WHERE low_fee_70",
    "month_all": """
      SELECT block_month, count(*) AS all_txs, CAST(sum(virtual_size) AS BIGINT) AS all_vbytes
      FROM verdicts WHERE NOT is_coinbase GROUP BY block_month""",
    "month_full": """
      SELECT block_month, CAST(sum(virtual_size) AS BIGINT) AS full_vbytes FROM flagged
      WHERE is_full AND floor_fee_rate IS NOT NULL AND NOT is_nonrelayable AND NOT is_coinbase
      GROUP BY block_month""",
    "month_low": "SELECT block_month, " + ", ".join(
        f"count(*) FILTER (WHERE low_fee_{s}) AS txs_{s}, "
        f"CAST(coalesce(sum(virtual_size) FILTER (WHERE low_fee_{s}), 0) AS BIGINT) "
        f"AS vbytes_{s}, "
        f"coalesce(sum(lower_band_sats) FILTER (WHERE low_fee_{s}), 0) AS lower_{s}, "
        f"coalesce(sum(upper_band_sats) FILTER (WHERE low_fee_{s}), 0) AS upper_{s}"
        for s, _ in SENS) + " FROM low GROUP BY block_month",
    "month_nonrelay": "SELECT block_month, count(*) FILTER (WHERE is_nonrelayable) "
        "AS nonrelayable_txs, CAST(sum(CASE WHEN is_nonrelayable THEN virtual_size ELSE 0 END) "
        "AS BIGINT) AS nonrelayable_vbytes, " + ", ".join(
            f"count(*) FILTER (WHERE nonrelay_{r}) AS {r}_txs"
            for r in (*REASONS, "ancestor_limit"))
        + " FROM verdicts WHERE NOT is_coinbase GROUP BY block_month",
    "monthly": "SELECT a.block_month, a.all_txs, a.all_vbytes, "
        "coalesce(f.full_vbytes, 0) AS full_block_vbytes, " + ", ".join(
            f"coalesce(l.txs_{s}, 0) AS low_fee_txs_{s}, "
            f"coalesce(l.vbytes_{s}, 0) AS low_fee_vbytes_{s}, "
            f"CAST(l.vbytes_{s} AS DOUBLE) / NULLIF(f.full_vbytes, 0) "
            f"AS private_vbytes_share_{s}, "
            f"CAST(coalesce(l.lower_{s}, 0) AS DOUBLE) AS lower_band_sats_{s}, "
            f"CAST(coalesce(l.upper_{s}, 0) AS DOUBLE) AS upper_band_sats_{s}"
            for s, _ in SENS)
        + ", n.nonrelayable_txs, n.nonrelayable_vbytes, CAST(n.nonrelayable_vbytes AS DOUBLE) "
        "/ NULLIF(a.all_vbytes, 0) AS nonrelayable_vbytes_share, "
        + ", ".join(f"n.{r}_txs" for r in (*REASONS, "ancestor_limit"))
        + " FROM month_all a LEFT JOIN month_full f USING (block_month) "
        "LEFT JOIN month_low l USING (block_month) LEFT JOIN month_nonrelay n "
        "USING (block_month)",
    "pools": """
      SELECT pool_name, block_month, count(DISTINCT block_number) AS blocks,
        CAST(sum(virtual_size) AS BIGINT) AS vbytes,
        CAST(coalesce(sum(virtual_size) FILTER (WHERE is_full AND floor_fee_rate IS NOT NULL
          AND NOT is_nonrelayable), 0) AS BIGINT) AS full_block_vbytes,
        count(*) FILTER (WHERE low_fee_50) AS low_fee_txs_50,
        CAST(sum(CASE WHEN low_fee_30 THEN virtual_size ELSE 0 END) AS BIGINT)
          AS low_fee_vbytes_30,
        CAST(sum(CASE WHEN low_fee_50 THEN virtual_size ELSE 0 END) AS BIGINT)
          AS low_fee_vbytes_50,
        CAST(sum(CASE WHEN low_fee_70 THEN virtual_size ELSE 0 END) AS BIGINT)
          AS low_fee_vbytes_70,
        CAST(coalesce(sum(lower_band_sats) FILTER (WHERE low_fee_50), 0) AS DOUBLE)
          AS lower_band_sats_50,
        CAST(coalesce(sum(upper_band_sats) FILTER (WHERE low_fee_50), 0) AS DOUBLE)
          AS upper_band_sats_50
      FROM flagged WHERE NOT is_coinbase GROUP BY pool_name, block_month""",
    "grid": """
      SELECT CAST(s AS DOUBLE) AS sensitivity, CAST(w AS BIGINT) AS full_weight
      FROM (VALUES (0.3), (0.5), (0.7)) a(s)
      CROSS JOIN (VALUES (3850000), (3900000), (3950000)) b(w)""",
    "grid_blocks": f"""
      SELECT g.sensitivity, g.full_weight, c.block_number, c.floor_fee_rate,
        c.median_fee_rate, c.weight >= g.full_weight
          AND count(*) FILTER (WHERE n.weight >= g.full_weight) >= 4 AS is_full
      FROM grid g CROSS JOIN blocks c CROSS JOIN {OFFSETS}
      LEFT JOIN attributed n ON n.block_number = c.block_number + o
      GROUP BY g.sensitivity, g.full_weight, c.block_number, c.floor_fee_rate,
        c.median_fee_rate, c.weight""",
    "sensitivity": """
      SELECT block_month, sensitivity, full_weight, count(*) FILTER (WHERE low) AS low_fee_txs,
        CAST(coalesce(sum(virtual_size) FILTER (WHERE low), 0) AS BIGINT) AS low_fee_vbytes,
        CAST(sum(virtual_size) AS BIGINT) AS full_block_vbytes,
        CAST(coalesce(sum(virtual_size) FILTER (WHERE low), 0) AS DOUBLE)
          / NULLIF(sum(virtual_size), 0) AS low_fee_share,
        CAST(coalesce(sum((f_floor - effective_fee_rate) * virtual_size)
          FILTER (WHERE low), 0) AS DOUBLE) AS lower_band_sats,
        CAST(coalesce(sum(f_median * virtual_size) FILTER (WHERE low), 0) AS DOUBLE)
          AS upper_band_sats
      FROM (SELECT v.block_month, v.virtual_size, v.effective_fee_rate, g.sensitivity,
          g.full_weight, g.floor_fee_rate AS f_floor, g.median_fee_rate AS f_median,
          v.effective_fee_rate < g.sensitivity * g.floor_fee_rate AS low
        FROM grid_blocks g JOIN verdicts v USING (block_number)
        WHERE g.is_full AND g.floor_fee_rate IS NOT NULL AND NOT v.is_coinbase
          AND NOT v.is_nonrelayable)
      GROUP BY block_month, sensitivity, full_weight""",
    "onchain": """
      SELECT block_month, count(*) AS txs, count(DISTINCT block_number) AS blocks,
        CAST(sum(fee) AS BIGINT) AS fee_sats, CAST(sum(virtual_size) AS BIGINT) AS vbytes,
        CAST(sum(fee) AS DOUBLE) / NULLIF(sum(virtual_size), 0) AS fee_rate_sat_vb
      FROM base WHERE NOT is_coinbase GROUP BY block_month""",
    "acc_months": """
      SELECT '2023-12' AS month UNION SELECT DISTINCT month FROM acc""",
    "acc_fees": """
      SELECT a.month, p.pool_name, CAST(sum(coalesce(a.fee_delta, 0)) AS BIGINT) AS fee_sats
      FROM acc a JOIN pool_ids p USING (pool_id)
      WHERE a.status LIKE '%completed%' GROUP BY a.month, p.pool_name""",
    "acc_spine": """
      SELECT m.month, f.pool_name, f.fee_sats, coalesce(CAST(sum(f.fee_sats)
        OVER (PARTITION BY m.month) AS BIGINT), 0) AS month_sum
      FROM acc_months m LEFT JOIN acc_fees f USING (month)""",
}


# The quadratic parts run once, not once per reference.
_ONCE = {"reach", "forebears", "verdicts", "flagged", "blocks", "percentiles"}


def oracle(select: str) -> str:
    """The statement for one query: every relation, then ``select``."""
    body = ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in _ONCE - {'reach', 'forebears'} else ''}({q})"
        for n, q in RELATIONS.items())
    return f"WITH RECURSIVE {with_clause('duckdb')},\n{body}\n{select}"
