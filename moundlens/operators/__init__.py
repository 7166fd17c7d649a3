"""DataFrame -> DataFrame building blocks shared by reports, studies and models."""
