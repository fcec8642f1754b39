"""All registered queries of this package."""

from plumbline.llm import exact_dedup, filter_audit, fingerprint, html_text, license_scan, line_dedup, near_dedup, packing, quality, resampling, residual_packing, suffix_dedup, unigram  # noqa: F401
from plumbline.llm.base import ORACLE, QUERIES  # noqa: F401
