"""Business KPIs for sales and marketing tables, as PySpark DataFrame transforms."""
