"""skeinwork: document intelligence and corpus preparation as DataFrame transformations on Spark."""
