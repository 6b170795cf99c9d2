"""From a model to DataFrame plans."""
