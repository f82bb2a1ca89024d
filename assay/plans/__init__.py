"""Reports, alerts and the scan job, composed from the operators."""
