"""folia: PySpark-native analytics for layout-aware, verified text."""
