from loanloom.sources.scenarios import load_scenarios, scenario_tables
from loanloom.sources.tables import (
    CSV_EXACT,
    CSV_LINES,
    CSV_NULL,
    constant_row,
    from_rows,
    load,
    preview,
    publish_view,
    run_sql,
    save,
)

__all__ = [
    "CSV_EXACT",
    "CSV_LINES",
    "CSV_NULL",
    "constant_row",
    "from_rows",
    "load",
    "load_scenarios",
    "preview",
    "publish_view",
    "run_sql",
    "save",
    "scenario_tables",
]
