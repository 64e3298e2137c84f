"""Endpoint specifications and fixed settings of the challenge workflow."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Endpoint:
    """One measured endpoint.

    ``tol_kind`` is ``"rel"`` (tolerance = ``tol`` times the endpoint's sample
    standard deviation over all input rows) or ``"abs"`` (tolerance = ``tol``).
    ``log_encoded`` endpoints are modelled as ``log10(x + 1)``; the others are
    already on a log scale. ``floor`` is the lower clip used by the display
    transform ``log10(max(x, floor))`` (None: no clip).
    """

    name: str
    log_encoded: bool = True
    tol_kind: str = "rel"
    tol: float = 0.3
    floor: float | None = None
    log_prefix: str = "Log"

    @property
    def log_name(self) -> str:
        return f"{self.log_prefix}{self.name}" if self.log_encoded else self.name


# ---------------------------------------------------------------------------
# They must equal the challenge workflow's settings.
# Endpoints, their noise tolerances (0.3 std for HLM, MLM and MDR1-MDCKII,
# 0.2 std for KSOL, 0.3 log units for LogD) and display floors (0.5, 0.5,
# 0.001, KSOL without floor).
ENDPOINTS = (
    Endpoint("HLM", True, "rel", 0.3, 0.5),
    Endpoint("MLM", True, "rel", 0.3, 0.5),
    Endpoint("LogD", False, "abs", 0.3, None),
    Endpoint("KSOL", True, "rel", 0.2, None),
    Endpoint("MDR1-MDCKII", True, "rel", 0.3, 0.001),
)
# Model-side property names, in prompt order.
PROPERTIES = ["LogHLM", "LogMLM", "LogD", "LogKSOL", "LogMDR1-MDCKII"]
TOPK_TARGET = 5
TOPK_EXTERNAL = 3
N_REPLICAS = 10
JITTER_SD = 0.02
RANDOM_SEED = 42
N_FOLDS = 5
FP_BITS = 1024
FP_RADIUS = 2
HIST_BINS = 30
# ---------------------------------------------------------------------------
