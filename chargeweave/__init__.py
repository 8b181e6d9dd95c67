"""EV-charging telemetry analytics as lazy Spark DataFrame plans."""
