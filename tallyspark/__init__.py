"""tallyspark: PySpark-native analytics over problem catalogs and practice activity."""
