"""Plans: what would be sent to the remote workspace, as tables. Nothing here touches a network."""
