"""Plan-time descriptions: frequencies, column roles, lags and validation windows. Nothing here runs a job."""
