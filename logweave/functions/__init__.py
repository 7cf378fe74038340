"""Column-level functions (parsing, time, rounding)."""

from logweave.functions.parse import (  # noqa: F401
    block_ids, decode_envelope, envelope_raw, event_time, normalise_event_id,
    normalise_label, parse_lines, primary_block_id, strip_ws,
)
from logweave.functions.timefmt import (  # noqa: F401
    iso, iso_utc, outcome, parse_iso_utc, round_half_even, round_metric, time_bucket,
)
