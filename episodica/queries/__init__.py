"""Registered queries; importing this package fills the registry."""

from episodica.queries import (  # noqa: F401
    align_q, episodes_q, flagship, geometry_q, metrics_q, mix_q, normalize_q, records_q, sensors_q, sources_q,
    streaming_q,
)
from episodica.queries import incremental_q, nulls_q, store_q  # noqa: F401, E402  (they use the SQL of the others)
