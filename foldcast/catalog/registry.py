"""Names of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldcast.catalog import queries as q

LINEAR_AND_FRAMES = """
price_bars order_bars event_grid wide_to_long instrument_pick
ffill_grid leading_null_drop fill_zero inf_guard date_cap
returns_1 returns_k returns_filled
supervised_3_1 supervised_2_3 supervised_multivar horizon_pairs
key_check index_check index_check_all length_check
split_train_val_test fold_schedule fold_schedule_growing
wf_val_rows fold_train_anti fold_targets_semi fold_score_rows
lr_single_split lr_multi_feature lr_no_intercept lr_nonneg lr_nonneg_wide
wf_lr_sliding wf_lr_suppliers wf_lr_growing wf_lr_refit7 wf_lr_two_features
wf_lr_long_returns wf_lr_blocked wf_random_validation wf_random_growing wf_custom_blackbox wf_custom_blackbox_growing
svr_tube_single wf_svr_tube wf_svr_tube_growing
wf_svr_flat wf_svr_log wf_custom_mean wf_custom_ridge custom_split
wf_error wf_sq_error wf_metrics cum_log_return cum_log_return_single cum_log_return_models
reattach_dates grid_leaderboard grid_settings model_roundtrip wf_model_reload wf_model_asof stream_bars stream_score csv_roundtrip
"""

AUTOREGRESSIVE = """
kpss_level arx_order_aic arx_fit arx_split wf_arx_forecast wf_arx_sliding wf_arx_same_steps wf_arx_difference
wf_arx_difference_sliding arma_hr arma_hr_sliding arma_split
"""

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(q, name) for name in (LINEAR_AND_FRAMES + AUTOREGRESSIVE).split()}
