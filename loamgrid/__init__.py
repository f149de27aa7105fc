"""loamgrid: geospatial, temporal, retrieval and corpus analytics as Spark DataFrame jobs."""
