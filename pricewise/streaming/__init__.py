"""Incremental forms of the daily demand build (Structured Streaming)."""

from pricewise.streaming.incremental import (daily_demand_windowed, merged_daily_demand,
                                             run_incremental_daily_demand)

__all__ = ["run_incremental_daily_demand", "merged_daily_demand", "daily_demand_windowed"]
