"""PySpark-native analytics over multi-agent event logs."""
