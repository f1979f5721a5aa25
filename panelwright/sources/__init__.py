"""Panels from tables, files, wide frames and generators."""
from .panels import PANEL, attach_industry, attach_mcap, combine, dense, null_profile, panel_of, pivot_blocks, pivot_wide, supplier_month, unpivot_blocks, unpivot_long, user_day  # noqa: F401
