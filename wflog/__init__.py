"""wflog: Spark jobs over workflow event logs and the operational tables around them."""
