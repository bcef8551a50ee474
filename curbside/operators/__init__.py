"""DataFrame -> DataFrame operators. None of them runs a job on its own."""
