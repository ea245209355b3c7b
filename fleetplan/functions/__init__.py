"""Column functions."""

from fleetplan.functions.quantities import (
    format_mib,
    format_millicores,
    is_quantity,
    parse_mib,
    parse_millicores,
)
from fleetplan.functions.text import image_hash, parse_dependency_csv, pod_name

__all__ = [
    "format_mib",
    "format_millicores",
    "image_hash",
    "is_quantity",
    "parse_dependency_csv",
    "parse_mib",
    "parse_millicores",
    "pod_name",
]
