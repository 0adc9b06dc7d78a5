"""Empty on purpose: every input of the engine is bounded and read anew by each job."""
