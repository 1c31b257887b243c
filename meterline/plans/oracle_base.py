"""Pieces of the DuckDB oracles: the ledger, its measures, and prices resolved by hand for the twelve model names."""

from __future__ import annotations

from ..sources.tables import DUCKDB_USAGE

AS_OF = "2024-01-30"
#: Each model name's status, entry, price interval, threshold, base and long prices (in, out, read, 5m, 1h).
HAND_RATED = """
('atlas-3','exact','atlas-3','0000-01-01','9999-12-31',180000, 2.9,13.5,0.33,3.6,5.4, 5.6,21.5,0.66,7.1,10.9),
('us.anthropic.atlas-3[1m]','exact','atlas-3','0000-01-01','9999-12-31',180000, 2.9,13.5,0.33,3.6,5.4, 5.6,21.5,0.66,7.1,10.9),
('atlas-3.5','exact','atlas-3.5','0000-01-01','9999-12-31',NULL, 3.7,14.9,0.42,4.6,7.3, 3.7,14.9,0.42,4.6,7.3),
('atlas-3-20260101','borrowed','atlas-3','0000-01-01','9999-12-31',180000, 2.9,13.5,0.33,3.6,5.4, 5.6,21.5,0.66,7.1,10.9),
('atlas-3-52','borrowed','atlas-3.5','0000-01-01','9999-12-31',NULL, 3.7,14.9,0.42,4.6,7.3, 3.7,14.9,0.42,4.6,7.3),
('borea-2-mini-preview','borrowed','borea-2-mini','0000-01-01','9999-12-31',NULL, 0.22,1.9,0.004321,0,0, 0.22,1.9,0.004321,0,0),
('borea-2','exact','borea-2','0000-01-01','2024-01-15',NULL, 1.15,9.3,0.117,1.45,1.45, 1.15,9.3,0.117,1.45,1.45),
('borea-2','exact','borea-2','2024-01-15','9999-12-31',NULL, 0.95,7.7,0.117,1.45,1.45, 0.95,7.7,0.117,1.45,1.45),
('openai.vendor/borea-9','borrowed','borea-2','0000-01-01','2024-01-15',NULL, 1.15,9.3,0.117,1.45,1.45, 1.15,9.3,0.117,1.45,1.45),
('openai.vendor/borea-9','borrowed','borea-2','2024-01-15','9999-12-31',NULL, 0.95,7.7,0.117,1.45,1.45, 0.95,7.7,0.117,1.45,1.45),
('cirrus-4.1-rapid','exact','cirrus-4.1-rapid','0000-01-01','2024-01-20',90000, 3.8,18.6,0.93,0,0, 7.4,36.8,0.93,0,0),
('cirrus-4.1-rapid','exact','cirrus-4.1-rapid','2024-01-20','9999-12-31',260000, 4.7,18.6,0.93,0,0, 9.2,18.6,0.93,0,0),
('cirrus-4-odd-rapid','unknown',NULL,'0000-01-01','9999-12-31',NULL, 1.7,6.3,0.21,2.1,2.1, 1.7,6.3,0.21,2.1,2.1),
('unknown','placeholder',NULL,'0000-01-01','9999-12-31',NULL, 1.7,6.3,0.21,2.1,2.1, 1.7,6.3,0.21,2.1,2.1),
('mystery-1','unknown',NULL,'0000-01-01','9999-12-31',NULL, 1.7,6.3,0.21,2.1,2.1, 1.7,6.3,0.21,2.1,2.1)
"""
#: The same rules as HAND_RATED's, for any name: the keys, and what a name without a key of its own may borrow from.
RESOLVE = r"""
  keys(key) AS (VALUES ('atlas-3'), ('atlas-3.5'), ('borea-2'), ('borea-2-mini'), ('cirrus-4.1'), ('cirrus-4.1-rapid'), ('dorado-5'), ('local-llm')),
  heirs(family, key, place) AS (VALUES ('atlas', 'atlas-3.5', 1000), ('atlas', 'atlas-3', 1001), ('borea', 'borea-2', 1002), ('cirrus', 'cirrus-4.1', 1003)),
  offers AS (
    SELECT model, key, 0 AS place FROM names JOIN keys ON key = clean
    UNION ALL SELECT model, key, 1 FROM names JOIN keys ON key = regexp_replace(clean, '-[0-9]{8}$', '') OR clean IN (key || '-eco', key || '-steady', key || '-steady-wide') WHERE starts_with(clean, 'dorado-')
    UNION ALL SELECT model, key, 1 FROM names JOIN keys ON clean IN (replace(key, '-rapid', '-eu-rapid'), replace(key, '-rapid', '-batch-rapid')) WHERE starts_with(clean, 'cirrus-4') AND contains(clean, '-rapid')
    UNION ALL SELECT model, key, 900 - length(key) FROM names JOIN keys ON starts_with(clean, key)
      WHERE NOT starts_with(clean, 'dorado-') AND NOT (starts_with(clean, 'cirrus-4') AND contains(clean, '-rapid'))
        AND NOT (clean[length(key) + 1] = '.' AND NOT contains(key, '.')) AND NOT regexp_matches(clean[length(key) + 1:], '^-[0-9]{1,2}([^0-9]|$)')
    UNION ALL SELECT model, key, place FROM names JOIN heirs ON starts_with(clean, family) WHERE NOT (starts_with(clean, 'cirrus-4') AND contains(clean, '-rapid'))),
  resolved AS (SELECT model, any_value(clean) AS clean, arg_min(key, place) AS key FROM names LEFT JOIN offers USING (model) GROUP BY model)"""
_T = "CAST({} AS DECIMAL(20,0))"
_P = "CAST(CASE WHEN request_prompt_tokens > thr THEN l_{0} ELSE r_{0} END AS DECIMAL(12,6))"


def _times(tokens: str, price: str) -> str:
    return f"{_T.format(tokens)} * {_P.format(price)}"


EV = DUCKDB_USAGE + """, ev AS (
  SELECT *, strftime(to_timestamp(ts) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR, '%Y-%m-%d') AS day,
    output_tokens + CASE WHEN source = 'opencode' THEN reasoning_tokens ELSE 0 END AS output_billed,
    total_tokens AS total_norm,
    CASE WHEN category = 'observer' AND source IN ('codex', 'grok') THEN 'claude_mem' ELSE source END AS display_source,
    CASE WHEN category = 'observer' AND source IN ('codex', 'grok') THEN 'claude-mem' END AS collector
  FROM usage_events
)"""
RATED = EV + f""", rated(rated_model, status, price_key, vf, vt, thr, r_in, r_out, r_read, r_5m, r_1h, l_in, l_out, l_read, l_5m, l_1h) AS (VALUES {HAND_RATED}
), pr AS (
  SELECT *, {_times('input_tokens', 'in')} + {_times('output_billed', 'out')} + {_times('cache_read_tokens', 'read')}
    + {_times('cache_creation_tokens', '5m')} + {_times('cache_creation_1h_tokens', '1h')} AS micro,
    {_T.format('cache_read_tokens')} * greatest(CAST(0 AS DECIMAL(13,6)), {_P.format('in')} - {_P.format('read')}) AS saved
  FROM ev JOIN rated ON model = rated_model AND day >= vf AND day < vt
)"""
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ["input_tokens", "output_billed", "cache_read_tokens", "cache_creation_tokens", "cache_creation_1h_tokens", "reasoning_tokens", "total_norm"])
COST = "round(CAST(sum(micro) AS DOUBLE) / 1e6, 4) AS cost_usd"
ALL = f"{SUMS}, count(*) AS records, {COST}"
PERIODS = f"""periods(period, lo, hi) AS (VALUES ('today', '{AS_OF}', '{AS_OF}'), ('yesterday', '2024-01-29', '2024-01-29'),
  ('week', '2024-01-24', '{AS_OF}'), ('month', '2024-01-01', '{AS_OF}'), ('all', '2000-01-01', '{AS_OF}'))"""


def within(period: str) -> str:
    low = {"today": AS_OF, "yesterday": "2024-01-29", "week": "2024-01-24", "month": "2024-01-01", "all": "2000-01-01"}[period]
    return f"day BETWEEN '{low}' AND '{'2024-01-29' if period == 'yesterday' else AS_OF}'"
