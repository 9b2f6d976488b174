from lapsewise.sources.published import Published, PublishConflict
from lapsewise.sources.raw import (
    pick_source,
    read_raw_members,
    read_raw_transactions,
    stream_raw_transactions,
    with_source,
)
from lapsewise.sources.tables import append_check_log, read_table, write_table

__all__ = [
    "PublishConflict", "Published", "append_check_log", "pick_source", "read_raw_members",
    "read_raw_transactions", "read_table", "stream_raw_transactions", "with_source", "write_table",
]
