"""quern: an analytics and master-data engine on PySpark."""
