"""DuckDB statements with the same result as the query of the same name."""
from oracles import incidents, kpis, stateless, metrics

ORACLES: dict[str, str] = {
    **stateless.SQL, **incidents.SQL, **kpis.SQL, **metrics.SQL,
}
