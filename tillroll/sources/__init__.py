from tillroll.sources.raw import read_raw, register_views, require_inputs  # noqa: F401
from tillroll.sources.store import Store, publish_atomic, read_table, write_report, write_table  # noqa: F401
