"""Point-process analytics on Spark: change detection, description-length costs, selection and result analytics."""
