"""Privacy analytics on Spark: detect, tokenize, redact, prove and report."""

import sys

from pyspark import cloudpickle

from cloakframe.operators.audit import egress_report, telemetry
from cloakframe.operators.detect import Detector, scan_elements, scan_text
from cloakframe.operators.incremental import diff_snapshots, scan_step
from cloakframe.operators.tokens import redact, reset_session, resolve_tokens, restore
from cloakframe.plans.privacy import Sanitized, sanitize

__all__ = [
    "Detector", "Sanitized", "diff_snapshots", "egress_report", "redact", "reset_session",
    "resolve_tokens", "restore", "sanitize", "scan_elements", "scan_step", "scan_text", "telemetry",
]

# Functions sent to Python workers travel by value, so a worker needs no copy of
# the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
