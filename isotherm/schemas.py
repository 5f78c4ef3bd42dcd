"""Tables and nested records as Spark types."""

from __future__ import annotations

#: Column lists in DDL form, by table.
WEATHER_DAILY = "city string, date date, tmin double, tmax double, tavg double"
METADATA = "city string, latitude double, longitude double, source string, start_date date, end_date date"
ANALYSIS_DAILY = WEATHER_DAILY + ", diurnal_range double, delta_1 double, delta_7 double, roll_mean_7 double, roll_std_7 double, anomaly_z double, doy_sin double, doy_cos double, time_idx double"
ANALYSIS_MONTHLY = "city string, year int, month int, tavg_mean double, tavg_std double, diurnal_mean double, roll_std_mean double, anomaly_mean double, delta_1_mean double"
EXECUTION_RUNS = "run_id string, started_at timestamp, finished_at timestamp, endpoint string, city string, status string, duration_ms bigint, params_json string, result_json string, error string"
INSIGHTS_CACHE = "city string, updated_at timestamp, analysis_run_id string, data_start date, data_end date, status string, payload_ref string, error string, version int"
#: The answer of a daily archive service.
ARCHIVE = "daily struct<time: array<string>, temperature_2m_max: array<double>, temperature_2m_min: array<double>, temperature_2m_mean: array<double>>"

#: Key columns of each table.
KEYS = {"weather_daily": ["city", "date"], "metadata": ["city"], "analysis_daily": ["city", "date"], "analysis_monthly": ["city", "year", "month"], "execution_runs": ["run_id"], "insights_cache": ["city"]}

#: Features of the cube in the order of their indices: 0 to 6 are numbers, 7 to 11 symbols.
NUMERIC = ["tavg", "tmin", "tmax", "diurnal_range", "delta_1", "roll_std_7", "anomaly_z"]
SYMBOLIC = ["temp_band", "trend_class", "anomaly_class", "diurnal_band", "season_class"]
