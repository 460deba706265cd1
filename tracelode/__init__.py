"""tracelode: a PySpark-native engine for append-only session logs."""
