"""vicinia: a PySpark-native engine for location-aware catalogue search and data curation."""
