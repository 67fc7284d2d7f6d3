"""Schemas of the tables that operators exchange. Matrices are rows of doubles; covariances are flat and row-major."""

PARAMS = "param_id string, N int, K int, lambda_r array<array<double>>, Phi_f array<array<double>>, Phi_h array<array<double>>, mu array<double>, sigma2 array<double>, Q_h array<array<double>>"
PANEL_LONG = "panel_id string, t int, date date, series_id string, value double"
PANEL_DENSE = "run_id string, t int, y array<double>"
SIMULATED = "run_id string, t int, y array<double>, f array<double>, h array<double>"
FILTERED = "run_id string, t int, state array<double>, cov array<double>, dim int, loglik double, clamped boolean"
SMOOTHED = "run_id string, t int, state array<double>, cov array<double>, lag1_cov array<double>, dim int"
PARTICLE = "run_id string, t int, state array<double>, cov array<double>, dim int, ess double, loglik double"
LOGLIK = "run_id string, param_id string, filter_type string, loglik double, loglik_constant double"
_P = "struct<N:int,K:int,lambda_r:array<array<double>>,Phi_f:array<array<double>>,Phi_h:array<array<double>>,mu:array<double>,sigma2:array<double>,Q_h:array<array<double>>>"
FIT = (
    "fit_id string, filter_type string, optimizer_name string, uses_transformations boolean, fix_mu boolean, prior_config_name string, success boolean, result_code string, "
    f"final_loss double, steps int, time_taken double, error_message string, final_params {_P}, loss_history array<double>, param_history array<{_P}>"
)
METRICS = (
    "run_id string, N int, K int, T int, filter_type string, num_particles int, seed bigint, rep int, param_gen_time double, data_sim_time double, filter_time double, "
    "rmse_f array<double>, corr_f array<double>, rmse_h array<double>, corr_h array<double>, loglik double, error string"
)
PARAM_ERRORS = (
    "id string, param string, bias double, mae double, rmse double, frob_diff double, frob_rel_diff double, rel_error double, eig_bias double, eig_mae double, eig_rmse double, "
    "logdet_diff double, trace_diff double"
)
FIT_METRICS = (
    "run_id string, N int, K int, T int, filter_type string, num_particles int, seed bigint, rep int, fix_mu boolean, optimizer_name string, success boolean, "
    "result_code string, steps int, final_loss double, loss_at_truth double, factor_rmse_mean double, factor_correlation_mean double, volatility_rmse_mean double, "
    "volatility_correlation_mean double, errors map<string,double>, fit_time double, total_time double, error string"
)
