"""Missing values."""

from __future__ import annotations

import tablekit as tk

from .base import HOLED, holed_events, query, rounded


def _events(spark, d):
    return holed_events(spark, d)


@query("fill_drop", f"SELECT * FROM {HOLED} WHERE value IS NOT NULL AND event_type IS NOT NULL")
def fill_drop(spark, d):
    return tk.fill_missing_values(_events(spark, d), "drop", columns=["value", "event_type"])


@query("fill_constant", f"""SELECT __row_index__, event_id, user_id, event_type, coalesce(value, -1) AS value FROM {HOLED}""")
def fill_constant(spark, d):
    return tk.fill_missing_values(_events(spark, d), "fill", -1, ["value"])


_NEIGHBOUR = """SELECT __row_index__, event_id, user_id,
  coalesce(event_type, {0}(event_type IGNORE NULLS) OVER w) AS event_type,
  coalesce(value, {0}(value IGNORE NULLS) OVER w) AS value FROM {1}
  WINDOW w AS (ORDER BY event_id {2} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("fill_forward", _NEIGHBOUR.format("last_value", HOLED, "ASC"))
def fill_forward(spark, d):
    return tk.fill_missing_values(_events(spark, d), "forward", columns=["event_type", "value"])


@query("fill_backward", _NEIGHBOUR.format("last_value", HOLED, "DESC"))
def fill_backward(spark, d):
    return tk.fill_missing_values(_events(spark, d), "backward", columns=["event_type", "value"])


@query("fill_mean", f"""SELECT __row_index__, event_id, user_id, event_type,
  round(coalesce(value, (SELECT avg(value) FROM {HOLED})), 4) AS value FROM {HOLED}""")
def fill_mean(spark, d):
    return rounded(tk.fill_missing_values(_events(spark, d), "mean", columns=["value", "event_type"]))


@query("fill_median", f"""SELECT __row_index__, event_id, user_id, event_type,
  round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {HOLED})), 4) AS value FROM {HOLED}""")
def fill_median(spark, d):
    return rounded(tk.fill_missing_values(_events(spark, d), "median", columns=["value"]))


_MODE = "(SELECT {0} FROM {1} WHERE {0} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("fill_mode", f"""SELECT __row_index__, event_id, user_id,
  coalesce(event_type, {_MODE.format("event_type", HOLED)}) AS event_type,
  coalesce(value, {_MODE.format("value", HOLED)}) AS value FROM {HOLED}""")
def fill_mode(spark, d):
    return tk.fill_missing_values(_events(spark, d), "mode", columns=["event_type", "value"])


@query("values_filled", f"""SELECT count(*)::BIGINT AS rows_affected,
  count(*) FILTER (WHERE value IS NULL)::BIGINT AS values_filled FROM {HOLED}""")
def values_filled(spark, d):
    events = _events(spark, d)
    return tk.values_filled(events, tk.fill_missing_values(events, "mean", columns=["value"]), ["value"])
