"""Column builders; everything here stays inside whole-stage code generation."""

from .hashing import hash32, hash_uniform  # noqa: F401
from .normal import lgamma, norm_cdf, norm_pdf, norm_ppf, norm_sf  # noqa: F401
from .scalar import (  # noqa: F401
    clip,
    confusion_code,
    expit,
    gaussian_shift_density,
    in_top_right,
    local_fdr,
    logit,
    mixture,
    nan_to_zero,
    neg_log10,
    valid_p,
    z_left,
    z_right,
)
