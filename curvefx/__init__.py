"""Distribution-valued outcomes on Spark: quantile curves, laws, effects and result ledgers."""
