"""Writers of a run's artefacts, all in a fixed order."""
